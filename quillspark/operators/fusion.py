"""Top-k, chunk-to-song aggregation and reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank.

    The limit of the window is pushed below the shuffle, so a task sends at
    most k rows a group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_chunk_per_song(chunk_hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, song_id, score, best_chunk_id) of chunk hits (query, chunk_id, song_id, score).

    A song scores as its best chunk; of equal chunks the one ranked first
    (score, then chunk_id) stays.
    """
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("chunk_id").alias("chunk_id"))).alias("m")
    return chunk_hits.groupBy(query, "song_id").agg(best).select(query, "song_id", (-F.col("m.neg")).alias("score"), F.col("m.chunk_id").alias("best_chunk_id"))


def mean_per_song(chunk_hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, song_id, score) with the mean of a song's chunk hits, for comparison."""
    return chunk_hits.groupBy(query, "song_id").agg(F.avg("score").alias("score"))


def reciprocal_rank_fusion(ranked: DataFrame, query: str = "query_id", k: int = RRF_K, more: Sequence[Column] = ()) -> DataFrame:
    """(query, song_id, score, n_lists, best_rank, rank) from ranked lists (query, arm, song_id, rank).

    Score is the sum of 1 / (k + rank) over the lists; ties go to the song in
    more lists, then to the better best rank, then to the smaller id.  The
    union is not trimmed.  ``more`` are further aggregates of a song's rows.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    fused = ranked.groupBy(query, "song_id").agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("n_lists"), F.min("rank").alias("best_rank"), *more
    )
    # the sum of the same terms in another order may differ in its last bit
    fused = fused.withColumn("score", F.round("score", 12))
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.desc("n_lists"), F.asc("best_rank"), F.asc("song_id"))
    return fused.withColumn("rank", F.row_number().over(order))
