"""Nearest neighbours over ``array<float>`` vectors by inner product.

Both searches work on blocks: some hundred vectors are one row with their ids
and one matrix, so that a task multiplies matrices and only k items a query
leave it.  The exact search pairs all blocks; the approximate one has blocks
per inverted list and pairs those of the lists a query probes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import SALTS, materialize, skewed_join
from .fusion import top_k

#: Vectors in a block; a block of either side is some hundred KB.
QUERY_BLOCK = 256
ITEM_BLOCK = 1024
#: Query blocks that are broadcast at most.
BROADCAST_BLOCKS = 64
DECIMALS = 6
#: Rows the lists are fitted on at most, lists at most, and the share of near neighbours that the probes are set to find in the sample.
SAMPLE = 20_000
MOST_LISTS = 1024
TARGET = 0.95
_HELD_OUT, _NEIGHBOURS, _ROUNDS = 400, 10, 15


def _packed(size: int):
    """Consecutive rows of one list to blocks."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = pdf["list"].to_numpy()
            edges = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1), len(pdf)]
            for a, b in zip(edges, edges[1:]):
                for at in range(a, b, size):
                    part = pdf.iloc[at : min(at + size, b)]
                    yield pd.DataFrame({"list": [int(part["list"].iloc[0])], "ids": [part.id.tolist()], "groups": [part["group"].tolist()], "matrix": [np.stack(part.v).astype("f4").tobytes()]})

    return pack


_BLOCK = "list int, ids array<string>, groups array<string>, matrix binary"


def _named(rows: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    """(list, id, group, v) of the rows that have a vector, all of list 0."""
    known = rows.where(F.col(vector).isNotNull())
    return known.select(F.lit(0).alias("list"), F.col(key).cast("string").alias("id"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("group"), F.col(vector).alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of at most ``size`` vectors of one list.  Blocks are cut where the rows lie."""
    return rows.mapInPandas(_packed(size), _BLOCK)


def _asked(rows: DataFrame) -> DataFrame:
    return materialize(_blocks(rows, QUERY_BLOCK).select("list", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), "query_blocks")


def _best(paired: DataFrame, k: int, grouped: bool = False) -> DataFrame:
    """(q, item, score): of each pair of blocks the k best items a query, or the k best groups with their best score.

    Equal scores go to the smaller name.  A group that is among the k best of
    all is among the k best of the block that holds its best item.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                v = np.frombuffer(row.matrix, dtype="f4").reshape(len(row.ids), -1).astype(np.float64)
                q = np.frombuffer(row.q_matrix, dtype="f4").reshape(len(row.q_ids), -1).astype(np.float64)
                s = np.round(q @ v.T, DECIMALS)
                names = np.asarray(row.groups if grouped else row.ids, dtype=str)
                if grouped:
                    order = np.argsort(names, kind="stable")
                    names, first = np.unique(names[order], return_index=True)
                    s = np.maximum.reduceat(s[:, order], first, axis=1)
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                else:
                    by_name = np.argsort(names, kind="stable")
                    best = by_name[np.argsort(-s[:, by_name], axis=1, kind="stable")[:, :k]]
                yield pd.DataFrame({"q": np.repeat(np.asarray(row.q_ids), best.shape[1]), "item": names[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    return paired.select("ids", "groups", "matrix", "q_ids", "q_matrix").mapInPandas(score, "q string, item string, score double")


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, query: str = "query_id", item: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query, item, score, rank): the k items of highest inner product per query, ties by item id.

    The stated query set meets all items in blocks.  Few query blocks are
    broadcast (their number is counted first); many are paired partition by
    partition.  Ids come out as strings.  Scores are doubles rounded to six
    places, and rank by the rounded score.
    """
    return _all_pairs(queries, vectors, k, query, item, vector, None)


def exact_top_groups(queries: DataFrame, vectors: DataFrame, k: int, group: str, *, query: str = "query_id", item: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query, group, score, rank): the k groups whose best item has the highest inner product, ties by group; rows of null group are left out."""
    return _all_pairs(queries, vectors.where(F.col(group).isNotNull()), k, query, item, vector, group)


def _all_pairs(queries: DataFrame, vectors: DataFrame, k: int, query: str, item: str, vector: str, group: str | None) -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    asked = _asked(_named(queries, query, vector)).drop("list")
    if asked.count() <= BROADCAST_BLOCKS:
        asked = F.broadcast(asked)
    partial = _best(_blocks(_named(vectors, item, vector, group), ITEM_BLOCK).crossJoin(asked), k, group is not None)
    if group:
        partial = partial.groupBy("q", "item").agg(F.max("score").alias("score"))
    best = top_k(partial, ["q"], [F.desc("score"), F.asc("item")], k)
    return best.select(F.col("q").alias(query), F.col("item").alias(group or item), "score", "rank")


@dataclass
class Lists:
    """Inverted lists fitted on a sample: directions of the lists, and how many a query probes."""

    centroids: np.ndarray
    probes: int

    def near(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n lists of the directions nearest to each vector, nearest first."""
        return np.argsort(-(_directions(vectors) @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def dumps(self) -> str:
        return json.dumps({"probes": self.probes, "centroids": self.centroids.tolist()})

    @classmethod
    def loads(cls, text: str) -> Lists:
        held = json.loads(text)
        return cls(np.array(held["centroids"], dtype=np.float64), held["probes"])


def _directions(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fit_lists(vectors: DataFrame, *, item: str = "chunk_id", vector: str = "embedding", lists: int | None = None, target: float = TARGET, sample: int = SAMPLE, seed: int = 0) -> Lists:
    """Lists by k-means of directions, fitted on at most ``sample`` rows, the first in a fixed random order of ids.

    There are about the root of the number of rows, at most ``MOST_LISTS``.
    The probes are the fewest lists that hold ``target`` of the ten nearest
    neighbours of held-out sample rows, found by brute force in the sample;
    the neighbours of a larger table are nearer, and so found more surely.
    An empty table has one list.
    """
    rows = _named(vectors, item, vector)
    n = rows.count()
    drawn = rows.select("id", "v").orderBy(F.md5(F.concat(F.col("id"), F.lit(f":{seed}"))), "id").limit(sample).toPandas()
    if drawn.empty:
        return Lists(np.zeros((1, 1)), 1)
    x = np.stack(drawn.v).astype(np.float64)
    d = _directions(x)
    count = min(lists or int(np.ceil(np.sqrt(n))), MOST_LISTS, len(d))
    rng = np.random.default_rng(seed)
    centroids = d[rng.choice(len(d), count, replace=False)]
    for _ in range(_ROUNDS):
        of = (d @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, d)
        moved = _directions(sums)
        centroids = np.where(np.bincount(of, minlength=count)[:, None] > 0, moved, centroids)
    made = Lists(centroids, count)
    of = made.near(x, 1)[:, 0]
    held = x[:_HELD_OUT]
    s = held @ x.T
    s[np.arange(len(held)), np.arange(len(held))] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(_NEIGHBOURS, len(x) - 1)]
    place = np.argsort(made.near(held, count), axis=1)  # of each list in each query's order
    needed = np.sort(np.take_along_axis(place, of[near], 1).ravel())
    if len(needed):
        made.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1
    return made


def _assigned(rows: DataFrame, lists: Lists, n: int) -> DataFrame:
    """Rows (list, id, group, v) once for each of their n nearest lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ITEM_BLOCK):
                part = pdf.iloc[at : at + ITEM_BLOCK]
                near = lists.near(np.stack(part.v), n)
                again = part.iloc[np.repeat(np.arange(len(part)), near.shape[1])]
                yield again.assign(list=near.ravel().astype(np.int32))

    return rows.mapInPandas(run, "list int, id string, group string, v array<float>")


def list_blocks(vectors: DataFrame, lists: Lists, *, item: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The index: every row with a vector in a block of its list.  A list may hold most rows; its rows are spread by id."""
    rows = _assigned(_named(vectors, item, vector), lists, 1)
    rows = rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("list", "id")
    return _blocks(rows, ITEM_BLOCK)


def probe_top_k(queries: DataFrame, blocks: DataFrame, lists: Lists, k: int, *, query: str = "query_id", item: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query, item, score, rank) among the items of the lists each query probes, scored exactly.

    ``blocks`` should be a written table: of it only the blocks of probed lists are multiplied.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = _asked(_assigned(_named(queries, query, vector), lists, lists.probes).sortWithinPartitions("list", "id"))
    if asked.count() <= BROADCAST_BLOCKS:
        paired = blocks.join(F.broadcast(asked), "list")
    else:
        paired = skewed_join(blocks, asked, ["list"], F.element_at("ids", 1))
    best = top_k(_best(paired, k), ["q"], [F.desc("score"), F.asc("item")], k)
    return best.select(F.col("q").alias(query), F.col("item").alias(item), "score", "rank")


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, query: str = "query_id", item: str = "chunk_id", vector: str = "embedding", **how) -> DataFrame:
    """Fit, index and search in one go; ``how`` as in ``fit_lists``."""
    lists = fit_lists(vectors, item=item, vector=vector, **how)
    blocks = materialize(list_blocks(vectors, lists, item=item, vector=vector), "lists")
    return probe_top_k(queries, blocks, lists, k, query=query, item=item, vector=vector)


def save_lists(spark: SparkSession, lists: Lists, blocks: DataFrame, path: str) -> None:
    """Write the index; the blocks are sorted by list, so that row groups of other lists are skipped."""
    spark.createDataFrame([(lists.dumps(),)], "lists string").write.parquet(f"{path}/fitted")
    blocks.repartitionByRange("list").sortWithinPartitions("list").write.parquet(f"{path}/blocks")


def load_lists(spark: SparkSession, path: str) -> tuple[DataFrame, Lists]:
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks"), Lists.loads(spark.read.parquet(f"{path}/fitted").first()[0])


def overlap(a: DataFrame, b: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(query, n_a, n_shared): how many of a's items b has too."""
    hit = b.select(query, item).distinct().withColumn("hit", F.lit(1))
    return a.select(query, item).join(hit, [query, item], "left").groupBy(query).agg(F.count(F.lit(1)).alias("n_a"), F.count("hit").alias("n_shared"))
