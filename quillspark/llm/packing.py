"""Filling containers of fixed capacity, with lexical neighbours first.

Method: the items are parted into shards of bounded size; each shard has a
BM25 inverted index over all token ids of its items, weighted by the
document frequencies of the whole corpus; the largest unused item opens a
container and searches with all its tokens, its unused neighbours fill it in
order of score as far as they fit, and the last part of the room goes to the
largest unused items that still fit.

Shards are cut so that lexical neighbours meet: an item is keyed by the
commonest of its tokens that no more items have than a shard holds, and
sorted by the next two, so that a key can never be hot.

An item above the capacity is cut: its full lengths are containers of their
own, and what is left over is an item like any other.  Every other item stays
whole.  A shard is a fixed number of items of at most ``capacity`` tokens, so
its memory is bounded whatever the data.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .tokens import token_pieces

CAPACITY = 2048
SHARD_ITEMS = 2048
K1, B = 1.2, 0.75
#: Of a container, the share that is filled for fit when neighbours have taken the rest.
CLOSE_FIT = 0.125
_KEYS = 3
_TABLE = 1 << 22


class Corpus:
    """What BM25 needs to know of the whole corpus; arrays are as long as the vocabulary."""

    def __init__(self, n: int, mean_size: float, frequencies: np.ndarray) -> None:
        self.n, self.mean_size, self.frequencies = n, mean_size, frequencies

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Corpus:
        flat = np.concatenate([np.unique(i) for i in items]) if items else np.empty(0, dtype=np.int64)
        return cls(len(items), float(np.mean([len(i) for i in items])) if items else 0.0, np.bincount(flat))

    def idf(self, tokens: np.ndarray) -> np.ndarray:
        df = self.frequencies[tokens]
        return np.log1p((self.n - df + 0.5) / (df + 0.5))


class ShardIndex:
    """BM25 inverted index over the token ids of the items of one shard."""

    def __init__(self, items: list[np.ndarray], corpus: Corpus) -> None:
        self.n = len(items)
        sizes = np.array([len(i) for i in items], dtype=np.int64)
        owner = np.repeat(np.arange(self.n), sizes)
        flat = np.concatenate(items).astype(np.int64) if self.n else np.empty(0, dtype=np.int64)
        pairs, tf = np.unique(flat * self.n + owner, return_counts=True) if self.n else (flat, flat)
        token, self.doc = pairs // max(self.n, 1), pairs % max(self.n, 1)
        names, self.term = np.unique(token, return_inverse=True)
        room = K1 * (1 - B + B * sizes[self.doc] / max(1.0, corpus.mean_size))
        self.weight = corpus.idf(names)[self.term] * tf * (K1 + 1) / (tf + room)
        order = np.argsort(self.doc, kind="stable")
        self.by_doc = np.split(self.term[order], np.cumsum(np.bincount(self.doc, minlength=self.n))[:-1]) if self.n else []
        self.bounds = np.searchsorted(self.term, np.arange(len(names) + 1))

    def forget(self, used: np.ndarray) -> None:
        """Leave out the postings of used items; they can't be found any more."""
        keep = ~used[self.doc]
        self.doc, self.term, self.weight = self.doc[keep], self.term[keep], self.weight[keep]
        self.bounds = np.searchsorted(self.term, np.arange(len(self.bounds)))

    def neighbours(self, seed: int, able: np.ndarray | None = None) -> np.ndarray:
        """Items (of those ``able``) that share a token with the seed, best first, ties by place."""
        terms = self.by_doc[seed]
        first = self.bounds[terms]
        length = self.bounds[terms + 1] - first
        at = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)
        found = np.flatnonzero(score > 0 if able is None else (score > 0) & able)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(items: list[np.ndarray], capacity: int = CAPACITY, corpus: Corpus | None = None, close_fit: float = CLOSE_FIT) -> list[list[int]]:
    """Containers as lists of item numbers; each item in exactly one."""
    sizes = [len(i) for i in items]
    index = ShardIndex(items, corpus or Corpus.of(items))
    by_size = sorted(range(len(items)), key=lambda i: (sizes[i], -i))
    keys = [(sizes[i], -i) for i in by_size]  # unused items, smallest first
    size = np.array(sizes, dtype=np.int64)
    used = np.zeros(len(items), dtype=bool)
    known = len(items)  # items with postings

    def take(i: int) -> int:
        used[i] = True
        at = bisect.bisect_left(keys, (sizes[i], -i))
        del keys[at]
        return sizes[i]

    out = []
    while keys:
        seed = -keys[-1][1]
        box, room = [seed], capacity - take(seed)
        if keys and room >= max(keys[0][0], capacity * close_fit):
            if 2 * len(keys) < known:
                index.forget(used)
                known = len(keys)
            for i in index.neighbours(seed, ~used & (size > 0) & (size <= room)).tolist():
                if sizes[i] <= room:
                    box.append(i)
                    room -= take(i)
                    if not keys or room < max(keys[0][0], capacity * close_fit):
                        break
        while keys:
            at = bisect.bisect_right(keys, (room, 1)) - 1
            if at < 0:
                break
            i = -keys[at][1]
            box.append(i)
            room -= take(i)
        out.append(box)
    return out


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column of an Arrow batch."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _distinct(flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct tokens of each row, in order; rows are ticked off in a table, some at a time."""
    n = len(cuts) - 1
    width = int(flat[cuts[0] : cuts[-1]].max(initial=0)) + 1
    step = max(1, _TABLE // width)
    found = []
    seen = np.zeros(step * width, dtype=bool)
    for at in range(0, n, step):
        part = cuts[at : at + step + 1]
        owner = np.repeat(np.arange(len(part) - 1) * width, np.diff(part))
        seen[owner + flat[part[0] : part[-1]]] = True
        pairs = np.flatnonzero(seen)
        seen[pairs] = False
        found.append(pairs + at * width)
    pairs = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    return pairs // width, pairs % width


def corpus_of(items: DataFrame) -> Corpus:
    """Document frequencies over all items (columns n_tokens, ids); as many numbers as the vocabulary has tokens come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            more = np.bincount(_distinct(*_lists(batch.column(0)))[1])
            if len(more) > len(total):
                total, more = more.astype(np.int64), total
            total[: len(more)] += more
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(total[token])], ["token", "n"])

    counted = items.select("ids").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    frequencies = np.zeros(int(counted.token.max()) + 1 if len(counted) else 0, dtype=np.int64)
    frequencies[counted.token.to_numpy()] = counted.n.to_numpy()
    return Corpus(size.n, float(size["mean"] or 0.0), frequencies)


def _keyed(items: DataFrame, corpus: Corpus, shard_items: int) -> DataFrame:
    """The items with their shard keys k1, k2, k3: their commonest tokens that 2 to ``shard_items`` items have; null where there are fewer."""
    schema = items.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, token = _distinct(*_lists(batch.column(batch.schema.get_field_index("ids"))))
            df = corpus.frequencies[token]
            fits = (df >= 2) & (df <= shard_items)
            row, token, df = row[fits], token[fits], df[fits]
            order = np.lexsort((token, -df, row))
            row, token = row[order], token[order]
            first = np.searchsorted(row, np.arange(batch.num_rows))
            end = np.append(first[1:], len(row))
            keys = []
            for k in range(_KEYS):
                there = first + k < end
                keys.append(pa.array(np.append(token, 0)[np.where(there, first + k, -1)].astype(np.int32), mask=~there))
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], [*batch.schema.names, "k1", "k2", "k3"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return items.mapInArrow(run, f"{fields}, k1 int, k2 int, k3 int")


def pack(documents: DataFrame, *, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, close_fit: float = CLOSE_FIT, path: str | None = None) -> DataFrame:
    """One row per item: container_id, slot, doc_id, piece, start_token, n_tokens.

    Every document is in: an empty or null text is an item of 0 tokens that
    takes a place in some container.  A container is named after its first
    item.  The tokens of the rows of a container add up to at most
    ``capacity``.  Repeated doc_ids are packed once each row.  Neighbours are
    taken until less than ``close_fit`` of the capacity is left.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    # written once: three readers follow (full pieces, the corpus statistics, the packing)
    items = materialize(token_pieces(documents, capacity, path=path), "items")
    full = F.col("n_tokens") == capacity
    name = F.concat_ws(":", "doc_id", "piece")
    own = items.where(full).select(name.alias("container_id"), F.lit(0).alias("slot"), "doc_id", "piece", "start_token", "n_tokens")
    rest = items.where(~full)
    corpus = corpus_of(rest)
    keyed = _keyed(rest.select("doc_id", "piece", "start_token", "ids"), corpus, shard_items)
    # items without a key of their own are spread by id
    keyed = keyed.withColumn("k1", F.coalesce("k1", -1 - F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 20)).cast("int")))
    shards = keyed.repartition("k1").sortWithinPartitions("k1", "k2", "k3", "doc_id", "piece").select("doc_id", "piece", "start_token", "ids")
    kinds = dict(zip(("container_id", "slot", "piece", "start_token", "n_tokens"), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())))
    names = ["container_id", "slot", "doc_id", "piece", "start_token", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, int, int, np.ndarray]] = []
        id_type = None

        def emit(rows):
            out = [[] for _ in names]
            for box in pack_shard([r[3] for r in rows], capacity, corpus, close_fit):
                label = f"{'' if rows[box[0]][0] is None else str(rows[box[0]][0]) + ':'}{rows[box[0]][1]}"
                for slot, i in enumerate(box):
                    for column, value in zip(out, (label, slot, rows[i][0], rows[i][1], rows[i][2], len(rows[i][3]))):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, id_type)) for c, n in zip(out, names)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            docs, pieces, starts = (batch.column(k).to_pylist() for k in range(3))
            flat, cuts = _lists(batch.column(3))
            for i in range(batch.num_rows):
                held.append((docs[i], pieces[i], starts[i], flat[cuts[i] : cuts[i + 1]].copy()))
                if len(held) == shard_items:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    return own.unionByName(shards.mapInArrow(run, f"container_id string, slot int, doc_id {kind}, piece int, start_token int, n_tokens int"))


def oversized(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id): the documents whose places in the containers add up to more than one container holds."""
    return packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > capacity).select("doc_id")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row on ``packed``: documents, over_capacity (containers), broken (documents whose pieces do not follow each other), containers, tokens, fill (share of the room used)."""
    packed = materialize(packed, "packed")
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("slot").alias("slot"))
    boxes = boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.sum(((F.col("n") > capacity) | (F.col("rows") != F.col("slot") + 1)).cast("int")).alias("over_capacity"))
    spans = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("piece").alias("piece"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"),
        F.sum((F.col("start_token") != F.col("piece") * capacity).cast("int")).alias("astray"),
    )
    broken = (F.col("rows") != F.col("piece") + 1) | (F.col("n") != F.col("end")) | (F.col("astray") > 0)
    spans = spans.agg(F.count(F.lit(1)).alias("documents"), F.sum(broken.cast("int")).alias("broken"))
    fill = F.col("tokens") / (F.col("containers") * capacity)
    return boxes.crossJoin(spans).select("documents", F.coalesce("over_capacity", F.lit(0)).alias("over_capacity"), F.coalesce("broken", F.lit(0)).alias("broken"), "containers", F.coalesce("tokens", F.lit(0)).alias("tokens"), fill.alias("fill"))
