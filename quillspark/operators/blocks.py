"""Searches of whole query sets over blocks of documents.

Some thousand documents are one row with their ids and their postings by
term, and some thousand queries are one row with their terms and weights.  A
task adds up the scores of one slice of queries over many blocks and only k
documents a query leave it, so that the pairs of queries and documents that
share a term are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

#: Documents in a block; a column of scores of a block stays in a core's cache.
DOCS = 4096
#: Queries in a slice: fewer only where there are too few slices for the cores, more never.
LEAST_QUERIES, MOST_QUERIES = 1024, 8192
#: Documents whose ids one task holds at most.
TASK_DOCS = 2_000_000
DECIMALS = 6
#: A term in more than one in so many documents of a block is a full column.
FULL = 8

_INDEX = "block string, docs array<string>, lengths binary, terms array<string>, dfs array<int>, places binary, tfs binary"


def _packed(v: np.ndarray) -> bytes:
    """Counts in as few bytes each as hold the largest."""
    kind = next(t for t in ("u1", "u2", "u4") if not len(v) or int(v.max()) <= np.iinfo(t).max)
    return v.astype(kind).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // n}") if n else np.zeros(0, dtype="u1")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        step = -(-batch.num_rows // max(1, -(-batch.num_rows // DOCS)))
        for first in range(0, batch.num_rows, max(1, step)):
            rows = batch.slice(first, step)
            # by id, so that of equal scores the first place has the smaller id
            rows = rows.take(pc.sort_indices(rows.column(0)))
            docs, lists = rows.column(0), rows.column(1)
            n = len(docs)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys, tfs = np.unique(codes * n + np.repeat(np.arange(n), lengths), return_counts=True)
            dfs = np.bincount(keys // n, minlength=len(coded.dictionary))
            yield pa.record_batch(
                [
                    pa.array([f"{part}-{made}"]), pa.array([docs.to_pylist()], pa.list_(pa.string())), pa.array([lengths.astype("u4").tobytes()], pa.binary()),
                    pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([dfs.tolist()], pa.list_(pa.int32())),
                    pa.array([(keys % n).astype("u2").tobytes()], pa.binary()), pa.array([_packed(tfs)], pa.binary()),
                ],
                names=["block", "docs", "lengths", "terms", "dfs", "places", "tfs"],
            )
            made += 1


def index(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """Written blocks of the documents' token counts; no shuffle.  A document is one row, its tokens may be null."""
    return materialize(docs.select(F.col(doc).cast("string").alias("doc"), tokens.alias("tokens")).mapInArrow(_index, _INDEX), "blocks")


def frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df) of all terms."""
    each = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    return each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))


def sizes(blocks: DataFrame) -> tuple[int, int]:
    """Number of documents and of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x, "u4") for x in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([len(x) for x in each], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in each], pa.int64())], names=["n", "total"])

    found = blocks.select("lengths").mapInArrow(run, "n bigint, total bigint").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return found.n or 0, found.total or 0


def with_norms(blocks: DataFrame, idf: DataFrame) -> DataFrame:
    """Written blocks whose ``factors`` are one over the length of each document's tf-idf vector; the blocks given are discarded."""
    each = blocks.select("block", F.posexplode("terms").alias("place", "term")).join(idf.select("term", "idf"), "term")
    of = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "idf"))).alias("m")).select("block", F.col("m.idf").alias("idfs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            factors = []
            for row in b.select(["lengths", "dfs", "places", "tfs", "idfs"]).to_pylist():
                dfs = np.asarray(row["dfs"] or [], dtype=np.int64)
                at = np.frombuffer(row["places"], "u2")
                w = _unpacked(row["tfs"], len(at)) * np.repeat(np.asarray(row["idfs"] or [], dtype=np.float64), dfs)
                norm = np.sqrt(np.bincount(at, weights=w * w, minlength=len(row["lengths"]) // 4))
                factors.append(np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0).tobytes())
            kept = [b.column(c) for c in ("docs", "terms", "dfs", "places", "tfs")]
            yield pa.record_batch([*kept, pa.array(factors, pa.binary())], names=["docs", "terms", "dfs", "places", "tfs", "factors"])

    out = blocks.join(of, "block", "left").mapInArrow(run, "docs array<string>, terms array<string>, dfs array<int>, places binary, tfs binary, factors binary")
    made = materialize(out, "norm_blocks")
    discard(blocks)
    return made


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries to slices: features are (term, weight), numbered by how many queries have them, so that sorted queries share long beginnings."""
    part, held = TaskContext.get().partitionId(), [r for b in batches for r in b.to_pylist()]
    for made, first in enumerate(range(0, len(held), MOST_QUERIES)):
        rows = held[first : first + MOST_QUERIES]
        count: dict[tuple[str, float], int] = {}
        bags = [[(x["term"], x["w"]) for x in r["bag"]] for r in rows]
        for bag in bags:
            for f in bag:
                count[f] = count.get(f, 0) + 1
        features = sorted(count, key=lambda f: (-count[f], f))
        number = {f: i for i, f in enumerate(features)}
        coded = sorted((sorted(number[f] for f in bag), i) for i, bag in enumerate(bags))
        order = [i for _, i in coded]
        yield pa.record_batch(
            [
                pa.array([f"{part}-{made}"]), pa.array([[rows[i]["query"] for i in order]], pa.list_(pa.string())), pa.array([np.array([rows[i]["scale"] for i in order]).tobytes()], pa.binary()),
                pa.array([[t for t, _ in features]], pa.list_(pa.string())), pa.array([np.array([w for _, w in features], dtype=np.float64).tobytes()], pa.binary()),
                pa.array([np.array([len(c) for c, _ in coded], dtype="u4").tobytes()], pa.binary()), pa.array([np.array([x for c, _ in coded for x in c], dtype="u4").tobytes()], pa.binary()),
            ],
            names=["slice", "queries", "scales", "q_terms", "weights", "counts", "codes"],
        )


class _Slice:
    """A slice of queries and the best documents found so far; scores are whole numbers of the last decimal."""

    def __init__(self, row: dict, k: int) -> None:
        self.queries, self.terms, self.k = row["queries"], row["q_terms"], k
        self.weights = np.frombuffer(row["weights"], "f8")
        self.scale = np.frombuffer(row["scales"], "f8") * 10**DECIMALS
        ends = np.cumsum(np.frombuffer(row["counts"], "u4"))[:-1]
        self.codes = [c.tolist() for c in np.split(np.frombuffer(row["codes"], "u4").astype(np.int64), ends)]
        self.shared = [0] * len(self.codes)
        for i in range(1, len(self.codes)):
            a, b = self.codes[i - 1], self.codes[i]
            self.shared[i] = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        n = len(self.queries)
        self.room = 3 * k
        self.scores, self.docs = np.zeros((n, self.room), np.int64), np.zeros((n, self.room), np.int64)
        self.held, self.least = [0] * n, [1] * n
        # a raw score below this can't round to the least wanted one
        self.bar = (0.5 / self.scale * (1 - 1e-9)).tolist()
        self.names: list[pa.Array] = []
        self.starts = [0]

    def name(self, doc: int) -> str:
        b = int(np.searchsorted(self.starts, doc, side="right")) - 1
        return self.names[b][doc - self.starts[b]].as_py()

    def cut(self, q: int) -> None:
        """Leave the k best of a query, of equal scores the smaller ids."""
        k, m = self.k, self.held[q]
        if m < k:
            return
        s, d = self.scores[q, :m], self.docs[q, :m]
        last = int(np.partition(s, m - k)[m - k])
        keep, tied = np.flatnonzero(s > last), np.flatnonzero(s == last)
        if len(tied) > k - len(keep):
            tied = np.array(sorted(tied, key=lambda i: self.name(int(d[i])))[: k - len(keep)], dtype=np.int64)
        keep = np.concatenate([keep, tied])
        self.scores[q, :k], self.docs[q, :k] = s[keep], d[keep]
        self.held[q], self.least[q] = k, last
        self.bar[q] = (last - 0.5) / self.scale[q] * (1 - 1e-9)

    def add(self, docs: pa.Array, place: dict[str, int], edges: list[int], at: np.ndarray, values: np.ndarray) -> None:
        """Score the queries over one block."""
        n, k, base = len(docs), self.k, self.starts[-1]
        self.names.append(docs)
        self.starts.append(base + n)
        columns: list[object] = []
        for t, w in zip(self.terms, self.weights.tolist()):
            i = place.get(t)
            if i is None:
                columns.append(None)
                continue
            a, b = edges[i], edges[i + 1]
            if (b - a) * FULL > n:
                full = np.zeros(n)
                full[at[a:b]] = values[a:b] * w
                columns.append(full)
            else:
                columns.append((at[a:b], values[a:b] * w))
        deepest = max(map(len, self.codes), default=0)
        own, levels = np.zeros((deepest + 1, n)), [None] * (deepest + 1)
        own, zero = list(own), own[0]
        levels[0] = zero
        bar, held, room = self.bar, self.held, self.room
        for q, codes in enumerate(self.codes):
            for j in range(self.shared[q], len(codes)):
                c = columns[codes[j]]
                if c is None:
                    levels[j + 1] = levels[j]
                elif type(c) is tuple:
                    mine = own[j + 1]
                    mine[:] = levels[j]
                    mine[c[0]] += c[1]
                    levels[j + 1] = mine
                else:
                    levels[j + 1] = np.add(levels[j], c, out=own[j + 1])
            s = levels[len(codes)]
            if s is zero:
                continue
            found = (s >= bar[q]).nonzero()[0]
            if not len(found):
                continue
            score = np.floor(s[found] * self.scale[q] + 0.5).astype(np.int64)
            if len(found) > k:
                last = np.partition(score, len(score) - k)[len(score) - k]
                keep, tied = np.flatnonzero(score > last), np.flatnonzero(score == last)
                keep = np.concatenate([keep, tied[: k - len(keep)]])
                found, score = found[keep], score[keep]
            good = score >= self.least[q]
            if not good.all():
                found, score = found[good], score[good]
            m, more = held[q], len(found)
            if m + more > room:
                self.cut(q)
                m = held[q]
            self.scores[q, m : m + more], self.docs[q, m : m + more] = score, found + base
            held[q] = m + more
            if m + more >= 2 * k or m < k <= m + more:
                self.cut(q)

    def best(self) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays(self.names) if self.names else pa.array([], pa.string())
        for first in range(0, len(self.queries), 1000):
            block = range(first, min(first + 1000, len(self.queries)))
            for q in block:
                if self.held[q] > self.k:
                    self.cut(q)
            n = [self.held[q] for q in block]
            docs = np.concatenate([self.docs[q, : self.held[q]] for q in block])
            scores = np.concatenate([self.scores[q, : self.held[q]] for q in block])
            asked = pa.array([self.queries[q] for q in block], pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.record_batch([asked, names.take(pa.array(docs)), pa.array(scores / 10**DECIMALS)], names=["query", "doc", "score"])


def top_documents(bags: DataFrame, query: str, blocks: DataFrame, n_docs: int, doc: str, k: int, avgdl: float | None = None, k1: float = 0.0, b: float = 0.0) -> DataFrame:
    """(query, doc, score): at least the k best documents of each query among those that score above 0, to six places.

    ``bags`` has one row per query (query, scale, bag array<struct<term, w>>);
    a score is scale times the sum of w times the document's part.  That is
    its tf times its factor (``with_norms``), or with ``avgdl`` the tf of BM25.
    Of equal scores the smaller ids are kept.  Documents of null id are never found.
    """
    spark = bags.sparkSession
    asked = materialize(bags.select(F.col(query).cast("string").alias("query"), "scale", "bag"), "bags")
    n = asked.count()
    tasks = 4 * spark.sparkContext.defaultParallelism
    parts = max(-(-n // MOST_QUERIES), min(tasks, -(-n // LEAST_QUERIES)), 1)
    sliced = asked.repartition(parts, F.col("query")).mapInArrow(_slice, "slice string, queries array<string>, scales binary, q_terms array<string>, weights binary, counts binary, codes binary")
    sliced = materialize(sliced, "slices").repartitionByRange(parts, "slice")
    held = "factors" if avgdl is None else "lengths"
    table = blocks.select("docs", "terms", "dfs", "places", "tfs", F.col(held).alias("held")).coalesce(max(-(-tasks // parts), -(-n_docs // TASK_DOCS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, _Slice] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                key = row["slice"].as_py()
                if key not in slices:
                    slices[key] = _Slice({c: row[c].as_py() for c in ("queries", "q_terms", "weights", "scales", "counts", "codes")}, k)
                docs = row["docs"].values
                dfs = row["dfs"].values.to_numpy()
                at = np.frombuffer(row["places"].as_buffer(), "u2")
                tf = _unpacked(row["tfs"].as_buffer(), len(at)).astype(np.float64)
                if avgdl is None:
                    values = tf * np.frombuffer(row["held"].as_buffer(), "f8")[at]
                else:
                    values = tf * (k1 + 1) / (tf + (k1 * (1 - b + b * np.frombuffer(row["held"].as_buffer(), "u4") / avgdl))[at])
                if docs.null_count:
                    values = values * pc.is_valid(docs).to_numpy(zero_copy_only=False)[at]
                place = {t: j for j, t in enumerate(row["terms"].values.to_pylist())}
                slices[key].add(pa.array(docs.to_pylist(), pa.string()), place, [0, *np.cumsum(dfs).tolist()], at.astype(np.int64), values)
        for s in slices.values():
            yield from s.best()

    found = table.crossJoin(sliced.hint("shuffle_replicate_nl")).mapInArrow(run, "query string, doc string, score double")
    kind: Callable[[DataFrame, str], object] = lambda df, c: df.schema[c].dataType
    return found.select(F.col("query").cast(kind(bags, query)).alias(query), F.col("doc").alias(doc), "score")
