"""Ingest and preprocess: one row per song, rejects with reasons, chunks without duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import sections

MIN_SONG_WORDS = 10
MIN_CHUNK_CHARS = 15


def first_per_key(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order (``dropDuplicates`` would take any).

    A partial minimum of the order's columns with the row, so that a key with
    many rows is never gathered.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.min(row).alias("m")).select(*keys, "m.row.*").select(*df.columns)


def ingest_songs(songs: DataFrame) -> DataFrame:
    """One row per song_id, the earliest ingested; repeated and late rows are skipped."""
    return first_per_key(songs, "song_id", [F.col("ingested_at"), F.col("source")])


def seeded_order(key: Column, seed: int) -> Column:
    """A fixed random order of keys: the same for the same seed, in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed; fewer if there are fewer."""
    return df.orderBy(seeded_order(F.col(key), seed), F.col(key)).limit(n)


def is_translation(artist: Column, title: Column) -> Column:
    said = lambda c: F.coalesce(c, F.lit("")).rlike(r"(?i)\btranslations?\b")
    return said(artist) | said(title)


def song_reject_reason(text: Column) -> Column:
    """Why a song is rejected, first reason first; null for a song that is kept."""
    stripped = tx.strip(F.coalesce(text, F.lit("")))
    return (
        F.when(stripped == "", "song_empty_text")
        .when(stripped.rlike(rf"(?iU)^\[?{tx.SPACE}*instrumental{tx.SPACE}*\]?$"), "song_instrumental_only")
        .when(tx.word_count(stripped) < MIN_SONG_WORDS, "song_too_short")
    )


def judge_songs(songs: DataFrame) -> DataFrame:
    """All songs with the translation flag set anew and their reject reason."""
    return songs.withColumn("is_translation", is_translation(F.col("artist"), F.col("title"))).withColumn("reject_reason", song_reject_reason(F.col("text_raw")))


def judge_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their reject reason: a repeated block of the same song first, then too short.

    The first block by position stays; a null text counts as empty.
    """
    hashed = chunks.withColumn("__block", tx.hash_block(F.coalesce("text", F.lit(""))))
    # one shuffle, by song and block: a block's copies are few even where a song is long
    first = F.min("position").over(Window.partitionBy("song_id", "__block"))
    reason = F.when(F.col("position") > first, "chunk_duplicate_block").when(F.length(F.coalesce("text", F.lit(""))) < MIN_CHUNK_CHARS, "chunk_too_short")
    return hashed.withColumn("reject_reason", reason).drop("__block")


def preprocess(songs: DataFrame, strategy: str = "sections") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(songs, chunks, rejects) of ingested songs.

    Positions are those before rejecting, so that kept chunks have gaps.
    Rejected songs are left out before they are chunked.
    """
    judged = judge_songs(songs)
    kept = judged.where("reject_reason is null").drop("reject_reason")
    chunks = judge_chunks(sections.chunk_songs(kept, strategy))
    blank = lambda kind: F.lit(None).cast(kind)
    of_songs = judged.where("reject_reason is not null").select(
        F.lit("song").alias("level"), F.col("reject_reason").alias("reason"), "song_id", "artist", "title",
        blank("int").alias("position"), blank("string").alias("text_preview"), blank("string").alias("chunk_id"), blank("string").alias("embedder_name"),
    )
    of_chunks = chunks.where("reject_reason is not null").join(kept.select("song_id", "artist", "title"), "song_id").select(
        F.lit("chunk").alias("level"), F.col("reject_reason").alias("reason"), "song_id", "artist", "title",
        "position", tx.preview(F.col("text")).alias("text_preview"), blank("string").alias("chunk_id"), blank("string").alias("embedder_name"),
    )
    passed = chunks.where("reject_reason is null").drop("reject_reason")
    return judged.drop("reject_reason"), passed, of_songs.unionByName(of_chunks)


def conservation(songs: DataFrame, chunks_before: DataFrame, chunks: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: what came in, passed and was rejected at both levels, and whether it adds up."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = n(songs, "songs_in").crossJoin(n(rejects.where("level = 'song'"), "songs_rejected"))
    row = row.crossJoin(n(chunks_before, "chunks_in")).crossJoin(n(chunks, "chunks_passed")).crossJoin(n(rejects.where("level = 'chunk'"), "chunks_rejected"))
    return row.withColumn("adds_up", F.col("chunks_in") == F.col("chunks_passed") + F.col("chunks_rejected"))


def duplicate_summary(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Per kind of key: how many values occur more than once, their rows and the rows too many."""
    parts = []
    for name, key in keys.items():
        groups = df.select(key.alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra")).select(F.lit(name).alias("key_kind"), "*"))
    return reduce(DataFrame.unionByName, parts)


def duplicate_samples(df: DataFrame, key: Column, record_id: str, n: int = 5, shown: int = 3) -> DataFrame:
    """(k, n_rows, ids): the ``n`` keys with most rows, ties by key, with the ``shown`` smallest ids of each."""
    named = df.select(key.alias("k"), F.col(record_id).alias("id")).where("k is not null")
    largest = named.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").orderBy(F.desc("n_rows"), "k").limit(n)
    w = Window.partitionBy("k").orderBy("id")
    # the limit of the window is taken before the shuffle
    ids = named.join(F.broadcast(largest.select("k")), "k", "left_semi").distinct().withColumn("i", F.row_number().over(w)).where(F.col("i") <= shown)
    return ids.groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(largest, "k").select("k", "n_rows", "ids")


def require_same_groups(summary: DataFrame, a: str, b: str) -> None:
    """Raise unless two kinds of key found equally many groups and rows, as an id made of a key must."""
    got = {r.key_kind: (r.n_groups, r.n_rows) for r in summary.where(F.col("key_kind").isin(a, b)).collect()}
    if got[a] != got[b]:
        raise ValueError(f"{a} and {b} disagree: {got[a]} and {got[b]} groups and rows")


def build_lookup(rows: DataFrame, known: DataFrame, key: str, order: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """(lookup, stats): the first tag per known key, and how many keys are covered or contradict themselves."""
    mine = rows.where(F.col(tag).isNotNull()).join(known.select(key).distinct(), key, "left_semi")
    found = mine.groupBy(key).agg(F.min_by(tag, F.struct(order, tag)).alias(tag), F.min(tag).alias("lo"), F.max(tag).alias("hi"))
    total = known.select(key).distinct().agg(F.count(F.lit(1)).alias("n_known"))
    stats = found.agg(F.count(F.lit(1)).alias("n_tagged"), F.coalesce(F.sum((F.col("lo") != F.col("hi")).cast("bigint")), F.lit(0)).alias("n_conflicts")).crossJoin(total)
    return found.select(key, tag), stats
