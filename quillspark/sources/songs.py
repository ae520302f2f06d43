"""Sources of songs.  A source is a callable from a session to a DataFrame of schema SONG."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.ingest import seeded_sample
from ..schemas import SONG

Source = Callable[[SparkSession], DataFrame]


def _required(column: str, where: Column) -> Column:
    return F.coalesce(column, F.raise_error(F.concat(F.lit(f"{column} is missing: "), where)).cast("string"))


@dataclass(frozen=True)
class ParquetSongs:
    """A Parquet corpus: optional seeded sample, lyrics null as empty, in order of id.

    ``columns`` maps id, artist, title and lyrics to the file's own names.
    """

    path: str
    tag: str = "parquet"
    sample_size: int | None = None
    seed: int = 42
    columns: tuple[tuple[str, str], ...] = (("id", "id"), ("artist", "artist"), ("title", "title"), ("lyrics", "lyrics"))

    def __call__(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path).select(*[F.col(theirs).alias(ours) for ours, theirs in self.columns])
        if self.sample_size is not None:
            rows = seeded_sample(rows, "id", self.sample_size, self.seed)
        return rows.orderBy("id").select(
            tx.make_song_id(F.col("artist"), F.col("title")).alias("song_id"), "artist", "title",
            F.coalesce("lyrics", F.lit("")).alias("text_raw"), F.lit(self.tag).alias("source"), F.lit(False).alias("is_translation"),
        )


@dataclass(frozen=True)
class JsonlSongs:
    """JSON lines, tolerant of missing fields but for artist and title.

    text_raw falls back to lyrics, then to empty; a missing or empty song_id
    is made from artist and title; blank lines are skipped.  A line that is
    no JSON, or lacks artist or title, raises when it is read, naming the file
    and the beginning of the line; ``faults`` has the numbers of all such lines.
    """

    path: str

    def __call__(self, spark: SparkSession) -> DataFrame:
        fields = T.StructType([*SONG.fields, T.StructField("lyrics", T.StringType()), T.StructField("_corrupt", T.StringType())])
        lines = spark.read.text(self.path).where(tx.strip(F.col("value")) != "")
        parsed = lines.select(F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value", F.col("_metadata.file_path").alias("file"))
        where = F.concat("file", F.lit(": "), F.substring("value", 1, 120))
        artist = F.when(F.col("r._corrupt").isNotNull(), F.raise_error(F.concat(F.lit("not a JSON record: "), where)).cast("string")).otherwise(_required("r.artist", where))
        named = parsed.select(artist.alias("artist"), _required("r.title", where).alias("title"), "r.song_id", "r.text_raw", "r.lyrics", "r.source", "r.is_translation", "file")
        made = tx.make_song_id(F.col("artist"), F.col("title"))
        return named.select(
            F.coalesce(F.nullif(F.col("song_id"), F.lit("")), made).alias("song_id"), "artist", "title",
            F.coalesce("text_raw", "lyrics", F.lit("")).alias("text_raw"),
            F.coalesce("source", F.lit(f"jsonl:{PurePath(self.path).name}")).alias("source"),
            F.coalesce("is_translation", F.lit(False)).alias("is_translation"),
        )


    def faults(self, spark: SparkSession) -> DataFrame:
        """(file, line, problem) of the lines that would raise."""
        from .records import file_lines

        lines = file_lines(spark, self.path).where(tx.strip(F.col("value")) != "")
        fields = T.StructType([T.StructField(c, T.StringType()) for c in ("artist", "title", "_corrupt")])
        r = lines.select("file", "line", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
        problem = F.when(F.col("r._corrupt").isNotNull(), "not a JSON record").when(F.col("r.artist").isNull(), "artist is missing").when(F.col("r.title").isNull(), "title is missing")
        return r.select("file", "line", problem.alias("problem")).where("problem is not null")


@dataclass(frozen=True)
class SongRows:
    """Rows held in memory, for tests and demos."""

    rows: tuple[tuple, ...]

    def __call__(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), SONG)


@dataclass(frozen=True)
class ScraperSongs:
    """The name of the web scraper; scraping itself is not implemented."""

    artist_or_query: str

    def __call__(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("scraping song pages is not implemented; read a Parquet or JSONL corpus")


_THEMES = "harbor orchard railway lantern winter desert river attic market thunder garden island mirror engine meadow canyon pillow compass saddle ribbon".split()
_TITLES = "at Dawn|at Dusk|in the Rain|Once More|for You|Far Away|Remembered|Unbroken|in Silence|Tonight".split("|")
_OPENINGS = "I walk beside|we carried|nobody remembers|somebody painted|she left behind|they follow|keep for me|I still hear".split("|")
_ENDINGS = "until the morning|under a quiet sky|with open hands|as the bells begin|and never look back|while the city sleeps".split("|")


def demo_songs() -> SongRows:
    """200 made-up songs: 20 themes in 10 variants, a verse, a chorus and in every other variant a bridge.

    Lines follow from their numbers, so the corpus is the same everywhere.
    """
    rows = []
    for t, theme in enumerate(_THEMES):
        for v, suffix in enumerate(_TITLES):
            line = lambda k: f"{_OPENINGS[(t + v + 3 * k) % len(_OPENINGS)]} the {theme} {_ENDINGS[(t * 5 + v * 2 + k) % len(_ENDINGS)]}"  # noqa: B023, E731
            parts = [("Verse", 4), ("Chorus", 3), *([("Bridge", 2)] if v % 2 == 0 else [])]
            text, at = [], 0
            for name, n in parts:
                text.append(f"[{name}]\n" + "\n".join(line(at + i) for i in range(n)))
                at += n
            rows.append((f"demo{t:02d}{v:02d}", f"The {theme.title()} Number {v + 1}", f"{theme.title()} {suffix}", "\n\n".join(text), "demo", False))
    return SongRows(tuple(rows))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Export as JSON lines, one folder of part files; nulls are written."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
