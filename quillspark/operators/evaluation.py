"""Evaluation of ranked results against relevant songs, sliced by their properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, mean_ci
from ..runtime import salted_join

UNKNOWN, MIXED, NONE = "(unknown)", "mixed", "(none)"


def outcomes(queries: DataFrame, hits: DataFrame, depth: int | None = None) -> DataFrame:
    """(query_id, query columns, ranked): the ranked song ids of each query, empty where it has none.

    A query's list is as long as its retrieval depth, which bounds the array.
    """
    shown = hits if depth is None else hits.where(F.col("rank") <= depth)
    lists = shown.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "song_id"))), lambda s: s["song_id"]).alias("ranked"))
    return queries.join(lists, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))


def query_metrics(outcomes: DataFrame, relevant: str = "relevant_song_ids") -> DataFrame:
    """The outcomes with one column per metric."""
    return outcomes.withColumns({name: f(F.col("ranked"), F.col(relevant)) for name, f in METRICS.items()})


def song_split_labels(songs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(song_id, split_label): how a song was split, and whether by force; '(unknown)' without chunks."""
    lo, hi = F.min("split_by"), F.max("split_by")
    per_song = chunks.groupBy("song_id").agg(F.when(lo == hi, lo).otherwise(MIXED).alias("split"), F.max(F.coalesce("force_split", F.lit(False))).alias("forced"))
    forced = F.when(F.col("forced"), "True").otherwise("False")
    labelled = songs.select("song_id").distinct().join(per_song, "song_id", "left")
    return labelled.select("song_id", F.coalesce(F.concat("split", F.lit("/force_split="), forced), F.lit(UNKNOWN)).alias("split_label"))


def query_labels(queries: DataFrame, labels: DataFrame, label: str, relevant: str = "relevant_song_ids") -> DataFrame:
    """(query_id, value): the label all relevant songs of a query share, else 'mixed'; '(unknown)' without any."""
    ids = queries.select("query_id", F.explode_outer(relevant).alias("song_id"))
    of = salted_join(ids, labels.select("song_id", F.col(label).alias("v")), ["song_id"], F.col("query_id"), "left").withColumn("v", F.coalesce("v", F.lit(UNKNOWN)))
    return of.groupBy("query_id").agg(F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(MIXED).alias("value"))


def slice_table(metrics: DataFrame, dimensions: dict[str, DataFrame], *, intervals: bool = False, n_boot: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, dimension, value, n, metric, mean[, ci_lo, ci_hi]): overall, then by each dimension's labels.

    ``dimensions`` maps a name to (query_id, value); a query it lacks counts as '(none)'.
    ``by`` names columns of ``metrics`` that part every slice, as the arm does.
    """
    long = metrics.select(*by, "query_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("x")) for m in METRICS])).alias("m")).select(*by, "query_id", "m.*")
    parts = [long.select(*by, F.lit("overall").alias("dimension"), F.lit("all").alias("value"), "query_id", "metric", "x")]
    for name, labels in dimensions.items():
        named = long.join(labels.select("query_id", "value"), "query_id", "left")
        parts.append(named.select(*by, F.lit(name).alias("dimension"), F.coalesce("value", F.lit(NONE)).alias("value"), "query_id", "metric", "x"))
    rows = reduce(DataFrame.unionByName, parts)
    keys = [*by, "dimension", "value", "metric"]
    if intervals:
        return mean_ci(rows, keys, "x", n_boot=n_boot)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def select_stratum(queries: DataFrame, stratum: str) -> DataFrame:
    """The queries of a stratum; raises if no query has a stratum at all, or none has this one."""
    if not queries.where(F.col("stratum").isNotNull()).take(1):
        raise ValueError("the evaluation set has no strata")
    chosen = queries.where(F.col("stratum") == stratum)
    if not chosen.take(1):
        raise ValueError(f"no query of stratum {stratum!r}")
    return chosen


def status_histogram(status: DataFrame) -> DataFrame:
    """Statuses other than ok and how many queries have them."""
    return status.where("status <> 'ok'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def column_label(df: DataFrame, column: Column) -> DataFrame:
    return df.select("query_id", F.coalesce(column.cast("string"), F.lit(NONE)).alias("value"))
