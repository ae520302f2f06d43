"""Scans of the other records: evaluation sets, replies, themes, pools, judgements, word vectors, query lists."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..runtime import materialize, ranked
from ..schemas import REPLY, STRATA, THEME


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, in order, lines from 1.

    Each file is one row until its lines are numbered, so a line keeps its
    place; for files that people write.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("n", "value")).select("file", (F.col("n") + 1).alias("line"), "value")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files of any size, lines from 1.

    Files are read in splits; a line's place is that of its split and its
    place in it, and the number comes from a distributed ranking.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    return ranked(rows, ["file"], [F.asc("start"), F.asc("at")], "line", "lines").select("file", "line", "value")


def write_with_meta(df: DataFrame, path: str, meta: dict, order: list[str]) -> None:
    """Records as JSON lines in order behind a first line ``{"_meta": ...}``, in one folder; it must not be there yet.

    Rows are range-partitioned by ``order``, so the part files follow each
    other in order and no task sees all rows.
    """
    spark = df.sparkSession
    head = spark.createDataFrame([(json.dumps({"_meta": meta}, ensure_ascii=False, sort_keys=True),)], "value string")
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    head.coalesce(1).union(lines).write.mode("errorifexists").text(path)


def read_with_meta(spark: SparkSession, path: str, schema: T.StructType) -> tuple[dict, DataFrame]:
    """(the file's own description, its records) of what ``write_with_meta`` wrote; no description is an empty one."""
    lines = spark.read.text(path).where(tx.strip(F.col("value")) != "")
    head = lines.where(is_meta(F.col("value"))).limit(1).collect()
    return (json.loads(head[0].value)["_meta"] if head else {}), lines.where(~is_meta(F.col("value"))).select(F.from_json("value", schema).alias("r")).select("r.*")


def replace_with_meta(df: DataFrame, path: str, meta: dict, order: list[str]) -> None:
    """``write_with_meta`` over an older folder: written beside it and renamed into its place when it is whole."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old, at = (hadoop.Path(f"{path}{end}") for end in (".new", ".old", ""))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(new, True)
    write_with_meta(df, f"{path}.new", meta, order)
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def genre_lookup(spark: SparkSession, root: str, corpus: str) -> DataFrame:
    """(song_id, genre) of a corpus; a missing table raises naming what builds it."""
    path = f"{root}/{corpus}/genres"
    try:
        return spark.read.parquet(path).select("song_id", "genre")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no genre table at {path}; make it with records.write_genre_lookup") from e
        raise


def write_genre_lookup(rows: DataFrame, songs: DataFrame, root: str, corpus: str, order: str = "id") -> DataFrame:
    """Write the lookup of ``ingest.build_lookup`` for the songs of a corpus; returns its statistics."""
    from ..operators.ingest import build_lookup

    lookup, stats = build_lookup(rows, songs, "song_id", order, "genre")
    lookup.write.mode("overwrite").parquet(f"{root}/{corpus}/genres")
    return stats


def is_meta(value: Column) -> Column:
    """Whether a JSON line is a file's own description and no record."""
    return F.get_json_object(value, "$._meta").isNotNull()


def eval_set(spark: SparkSession, path: str, known_songs: DataFrame, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """A validated evaluation set: query_id, query, relevant_song_ids, query_type, stratum.

    Lines with ``_meta`` and blank lines are skipped; repeated relevant ids
    count once.  Raises naming file and line on the first line that is no
    JSON object, has an unknown field, lacks a query or relevant ids, names an
    unknown stratum or a song that does not exist, and on an empty set.
    """
    lines = numbered_lines(spark, path).where((tx.strip(F.col("value")) != "") & ~is_meta(F.col("value")))
    fields = "struct<query:string,relevant_song_ids:array<string>,query_type:string,stratum:string,_bad:string>"
    r = lines.select("file", "line", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.json_object_keys("value").alias("keys"))
    unknown = F.array_except("keys", F.array(*[F.lit(k) for k in ("query", "relevant_song_ids", "query_type", "stratum")]))
    problem = (
        F.when(F.col("keys").isNull() | F.col("r._bad").isNotNull(), F.lit("not a JSON object with these types"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), unknown[0]))
        .when(F.coalesce(tx.strip(F.col("r.query")), F.lit("")) == "", F.lit("query is missing"))
        .when(F.coalesce(F.size("r.relevant_song_ids"), F.lit(0)) < 1, F.lit("relevant_song_ids is missing"))
        .when(F.exists("r.relevant_song_ids", lambda x: x.isNull()), F.lit("a relevant song id is null"))
        .when(F.col("r.stratum").isNotNull() & ~F.col("r.stratum").isin(*strata), F.concat(F.lit("unknown stratum "), F.col("r.stratum")))
    )
    checked = materialize(r.select("file", "line", "r.*", problem.alias("problem")).drop("_bad"), "eval_set")
    ids = checked.where("problem is null").select("file", "line", F.explode("relevant_song_ids").alias("song_id"))
    absent = ids.join(known_songs.select("song_id"), "song_id", "left_anti").select("file", "line", F.concat(F.lit("no such song: "), F.col("song_id")).alias("problem"))
    first = checked.where("problem is not null").select("file", "line", "problem").unionByName(absent).orderBy("file", "line", "problem").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].file}:{first[0].line}: {first[0].problem}")
    if not checked.take(1):
        raise ValueError(f"{path}: no queries")
    numbered = ranked(checked, [], [F.asc("file"), F.asc("line")], "query_id", "eval_ids")
    return numbered.select("query_id", "query", F.array_distinct("relevant_song_ids").alias("relevant_song_ids"), "query_type", "stratum")


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): lines of a text file without blank and # lines; raises if there are none."""
    kept = numbered_lines(spark, path).select("file", "line", tx.strip(F.col("value")).alias("query")).where("query <> '' and not startswith(query, '#')")
    if not kept.take(1):
        raise ValueError(f"{path}: no queries")
    return kept.select(F.col("line").cast("bigint").alias("query_id"), "query")


def replies(spark: SparkSession, paths: str) -> DataFrame:
    """Replies of all files, one per chunk and attempt (default 1): the first by file name and place."""
    rows = numbered_lines(spark, paths).where(tx.strip(F.col("value")) != "").select("file", "line", F.from_json("value", REPLY).alias("r")).select("file", "line", "r.*")
    rows = rows.withColumn("attempt", F.coalesce("attempt", F.lit(1)))
    rest = ["paraphrase", "description"]
    first = F.min(F.struct("file", "line", *rest)).alias("m")
    return rows.groupBy("chunk_id", "attempt").agg(first).select("chunk_id", "attempt", *[f"m.{c}" for c in rest])


def themes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Themes to pool, in order of the file; raises if a theme lacks theme_id, text or tier."""
    from ..operators.pooling import usable_themes

    lines = numbered_lines(spark, path).where((tx.strip(F.col("value")) != "") & ~is_meta(F.col("value")))
    where = F.concat_ws(":", "file", "line")
    parsed = lines.select(where.alias("at"), "line", F.from_json("value", THEME).alias("r")).select("at", "line", "r.*")
    for c in ("theme_id", "text", "tier"):
        parsed = parsed.withColumn(c, F.coalesce(c, F.raise_error(F.concat(F.lit(f"{c} is missing: "), F.col("at"))).cast("string")))
    kept = usable_themes(parsed).orderBy("line")
    return (kept if limit is None else kept.limit(limit)).drop("at", "line")


def probe_report(spark: SparkSession, path: str) -> DataFrame:
    """(query, place, hit, fragment) of a printed search report.

    A QUERY: line opens a query, a numbered line is a hit, indented lines
    after it are its fragment.
    """
    lines = numbered_lines(spark, path)
    w = Window.partitionBy("file").orderBy("line")
    header = F.when(F.col("value").startswith("QUERY: "), tx.strip(F.substr(F.col("value"), F.lit(8))))
    number = F.regexp_extract("value", r"^\s*(\d+)\. ", 1)
    marked = lines.withColumn("query", F.last(header, ignorenulls=True).over(w)).withColumn("number", F.when(number != "", number.cast("int")))
    marked = marked.where("query is not null and not startswith(value, 'QUERY: ')").withColumn("opened", F.last("number", ignorenulls=True).over(Window.partitionBy("file", "query").orderBy("line")))
    text = F.when(F.col("number").isNull() & F.col("value").rlike(r"^ {6}"), tx.strip(F.col("value")))
    pieces = marked.where("opened is not null").groupBy("query", F.col("opened").alias("place"))
    return pieces.agg(
        F.max(F.when(F.col("number").isNotNull(), tx.strip(F.regexp_replace("value", r"^\s*\d+\. ", "")))).alias("hit"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("line", text.alias("t"))))), lambda s: s["t"]), " ").alias("fragment"),
    )


def word_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(n, word, vector) of a .vec text file: one header line, then a word and its numbers a line.

    A limit keeps the first words of the file, as frequent words come first.
    """
    rows = file_lines(spark, path).select((F.col("line") - 1).alias("n"), "value").where("n > 0")  # the order of the file is the frequency
    if limit is not None:
        rows = rows.where(F.col("n") <= limit)
    parts = F.split(F.rtrim("value"), " ")
    return rows.select("n", F.get(parts, F.lit(0)).alias("word"), F.slice(parts, 2, F.size(parts)).cast("array<float>").alias("vector"))


def convert_word_vectors(spark: SparkSession, vec_path: str, out_path: str, limit: int, overwrite: bool = False) -> str:
    """A .vec file as Parquet at ``<out_path>.limit<N>``, in order of n.

    Raises if it exists already, holds fewer words, or gives back other words
    at some place than the text file.
    """
    where = f"{out_path}.limit{limit}"
    rows = word_vectors(spark, vec_path, limit)
    rows.repartitionByRange("n").sortWithinPartitions("n").write.mode("overwrite" if overwrite else "errorifexists").parquet(where)
    load_word_vectors(spark, where, limit)
    again = spark.read.parquet(where).select("n", F.col("word").alias("kept"))
    if rows.join(again, "n", "full").where(~F.col("word").eqNullSafe(F.col("kept"))).take(1):
        raise ValueError(f"{where} does not hold the words of {vec_path} in their order")
    return where


def load_word_vectors(spark: SparkSession, path: str, limit: int) -> DataFrame:
    table = spark.read.schema("word string, vector array<float>").parquet(path)
    if (n := table.count()) != limit:
        raise ValueError(f"{path} holds {n} words, not {limit}")
    return table
