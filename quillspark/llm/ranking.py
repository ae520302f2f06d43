"""One ranking from several differently scaled scores, by ideal points.

Method: scores are turned so that more is better, winsorised at the fences of
the exact quartiles of their list (one query, one arm), counted from the
list's worst value and vector-normalised.  The ideal point has the best
coordinate of every list, the anti-ideal point the worst; songs are sorted by
their relative closeness, anti-ideal distance over the sum of both distances.
All lists have weight one.

A query of ordinary size is worked out where its rows lie, in windows over
one shuffle by query.  The rows of hot queries (of which there can be only a
few hundred) are ranked by range partitions and their list statistics joined
back, so that no hot list is ever in one task.  Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import HOT_ROWS, counted_join, hot_keys, materialize, ranked, salted_join

FENCE = 1.5
_LIST = ["query_id", "arm"]
_INF = float("inf")


def latest_scores(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """(query_id, arm, song_id, x): the latest score of each, larger is better.

    Of rows with one scored_at the larger score counts.  Null and NaN scores
    drop out after the latest was taken, so an older score does not come back.
    An arm without a configuration is taken as higher-is-better.
    """
    usable = F.when(~F.isnan("score"), F.col("score"))
    latest = hits.groupBy("query_id", "arm", "song_id").agg(F.max(F.struct("scored_at", usable.alias("score"))).alias("m"))
    turn = configs.groupBy("arm").agg(F.max("higher_is_better").alias("higher"))
    scored = latest.select("query_id", "arm", "song_id", F.col("m.score").alias("score")).where(F.col("score").isNotNull())
    scored = counted_join(scored, turn, ["arm"], F.col("song_id"), "left")
    return scored.select("query_id", "arm", "song_id", F.when(F.col("higher") == F.lit(False), -F.col("score")).otherwise(F.col("score")).alias("x"))


def _finite(x: Column) -> Column:
    return (x > -_INF) & (x < _INF)  # NaN is above infinity


def _fenced(fence: float) -> tuple[Column, Column]:
    """Winsor bounds from q1, q3 and the least and largest finite value."""
    reach = (F.col("q3") - F.col("q1")) * fence
    low, high = F.col("q1") - reach, F.col("q3") + reach
    return F.when(_finite(low), low).otherwise(F.col("fmin")), F.when(_finite(high), high).otherwise(F.col("fmax"))


def _held(x: Column) -> Column:
    return F.least(F.greatest(x, "low"), "high")


def _unit() -> Column:
    """The winsorised score from the list's worst value, in units of its best, so that squares neither overflow nor vanish; 0 in a list that parts nothing."""
    top = F.col("best") - F.col("worst")
    return F.when((top > 0) & _finite(top), (_held(F.col("x")) - F.col("worst")) / top).otherwise(F.lit(0.0))


def _songs(rows: DataFrame) -> DataFrame:
    """Sums per song from rows with u (the score in units of the best) and ideal (one over the norm of the list's u)."""
    coordinate = F.col("u") * F.col("ideal")
    return rows.groupBy("query_id", "song_id").agg(
        F.count(F.lit(1)).alias("n_arms"),
        F.sum(F.pow(F.col("ideal") - coordinate, 2) - F.pow("ideal", 2)).alias("nearer"),
        F.sum(F.pow(coordinate, 2)).alias("from_worst"),
        F.max("whole").alias("whole"),
    )


def _in_place(scores: DataFrame, fence: float) -> DataFrame:
    """Sums per song of queries that one task can hold: one shuffle by query, windows over its lists."""
    per_list, per_query = Window.partitionBy(*_LIST), Window.partitionBy("query_id")
    rows = scores.repartition("query_id")
    rows = rows.withColumn("nth", F.row_number().over(per_list.orderBy("x", "song_id"))).withColumn("n", F.count(F.lit(1)).over(per_list))
    for name, share in (("q1", 0.25), ("q3", 0.75)):
        rows = rows.withColumn(name, F.max(F.when(F.col("nth") == F.ceil(F.col("n") * share), F.col("x"))).over(per_list))
    finite = F.when(_finite(F.col("x")), F.col("x"))
    rows = rows.withColumns({"fmin": F.min(finite).over(per_list), "fmax": F.max(finite).over(per_list), "least": F.min("x").over(per_list), "most": F.max("x").over(per_list)})
    low, high = _fenced(fence)
    rows = rows.withColumns({"low": low, "high": high})
    rows = rows.withColumns({"worst": _held(F.col("least")), "best": _held(F.col("most"))}).withColumn("u", _unit())
    squares = F.sum(F.col("u") * F.col("u")).over(per_list)
    rows = rows.withColumn("squares", squares).withColumn("ideal", F.when(F.col("squares") > 0, 1 / F.sqrt("squares")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("whole", F.sum(F.when(F.col("nth") == 1, F.col("ideal") * F.col("ideal"))).over(per_query))
    return _songs(rows)


def _spread(scores: DataFrame, fence: float) -> DataFrame:
    """The same sums for hot queries: ranks by range partitions, list statistics joined back by salted joins."""
    placed = materialize(ranked(scores, _LIST, [F.col("x").asc(), F.col("song_id").asc()], "nth", "placed"), "placed")
    finite = F.when(_finite(F.col("x")), F.col("x"))
    lists = placed.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.min(finite).alias("fmin"), F.max(finite).alias("fmax"))
    at = {q: F.max(F.when(F.col("nth") == F.ceil(F.col("n") * share), F.col("x"))).alias(q) for q, share in (("q1", 0.25), ("q3", 0.75))}
    quartiles = salted_join(placed, lists.select(*_LIST, "n"), _LIST, F.col("song_id")).groupBy(*_LIST).agg(*at.values())
    low, high = _fenced(fence)
    lists = lists.join(quartiles, _LIST).withColumns({"low": low, "high": high})
    lists = materialize(lists.select(*_LIST, "low", "high", _held(F.col("least")).alias("worst"), _held(F.col("most")).alias("best")), "lists")
    units = salted_join(placed, lists, _LIST, F.col("song_id")).select(*_LIST, "song_id", _unit().alias("u"))
    squares = units.groupBy(*_LIST).agg(F.sum(F.col("u") * F.col("u")).alias("squares"))
    norms = squares.select(*_LIST, F.when(F.col("squares") > 0, 1 / F.sqrt("squares")).otherwise(F.lit(0.0)).alias("ideal"))
    norms = materialize(norms.withColumn("whole", F.sum(F.col("ideal") * F.col("ideal")).over(Window.partitionBy("query_id"))), "norms")  # one row per list
    return _songs(salted_join(units, norms, _LIST, F.col("song_id")))


def ideal_point_scores(scores: DataFrame, *, fence: float = FENCE, hot: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query_id, song_id, n_arms, closeness) from (query_id, arm, song_id, x).

    Winsorising pulls values in to the quartiles less or plus ``fence``
    interquartile ranges; quartiles are values of the list, at the places
    n/4 and 3n/4 rounded up.  A song that a list lacks has the list's
    anti-ideal coordinate.  A list of equal scores parts nothing and adds
    nothing.  Infinite scores are pulled in to the fences, or to the last
    finite value where the quartiles are infinite.  With a single distinct
    value in every list all songs have closeness 0.  ``hot`` are the query_ids
    to spread over tasks, by default those of ``hot_rows`` rows and more.
    """
    if hot is None:
        hot = hot_keys(scores, ["query_id"], rows=hot_rows)
    ids = [r.query_id for r in hot.collect()]  # at most HOT_SHARE
    if ids:
        songs = _in_place(scores.where(~F.col("query_id").isin(ids) | F.col("query_id").isNull()), fence)
        songs = songs.unionByName(_spread(scores.where(F.col("query_id").isin(ids)), fence))
    else:
        songs = _in_place(scores, fence)
    d_best = F.sqrt(F.greatest(F.round(F.col("whole") + F.col("nearer"), 12), F.lit(0.0)))
    d_worst = F.sqrt("from_worst")
    close = F.when(d_best + d_worst > 0, d_worst / (d_best + d_worst)).otherwise(F.lit(0.0))
    return songs.select("query_id", "song_id", "n_arms", F.round(close, 9).alias("closeness"))


def rank_hits(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """Closeness of the songs of every query of ``hits``; hot queries are counted on its rows, before they are read for good."""
    return ideal_point_scores(latest_scores(hits, configs), hot=hot_keys(hits, ["query_id"]))


def first_songs(closeness: DataFrame) -> DataFrame:
    """The first song of each query; ties go to the smaller song_id."""
    first = F.min(F.struct((-F.col("closeness")).alias("c"), F.col("song_id").alias("song_id")))
    return closeness.groupBy("query_id").agg(first.alias("m")).select("query_id", F.col("m.song_id").alias("song_id"))


def full_ranking(closeness: DataFrame) -> DataFrame:
    """All songs of each query with their rank, best first, ties by song_id."""
    return ranked(closeness, ["query_id"], [F.col("closeness").desc(), F.col("song_id").asc()], "rank", "ranking")
