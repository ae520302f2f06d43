"""Near-duplicate texts, by fast similarity sketching.

Method: a text is the set of its word runs.  Its sketch of T coordinates is
filled in rounds of hashed bin placement: in round r < T every run falls into
a random bin, in round T + i into bin i; a bin keeps the smallest hash of the
first round that reaches it.  So every coordinate fills after 2T rounds at the
latest, mostly after T ln T / n, and the number of equal coordinates of two
sketches is concentrated about T times the Jaccard similarity like that of T
independent samples.  Bands of equal coordinates give candidates, and the
exact similarity of the sets of runs decides.

The band keys of a text never become rows.  Each task packs the keys of some
thousand texts into one block per bucket range; a block goes to the task of
its range, which sorts the keys of one range at a time and lets equal
neighbours meet.  The number of ranges grows with the texts, so that a range
stays within a fixed size, and a key that many texts share is walked by
distance, never held as a list of pairs.

Copies (equal word sequences) are one class first, so that a group of copies
is one row in all that follows.  Links are between class representatives;
``expand_pairs`` turns them into pairs of records where a caller wants those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..runtime import discard, materialize, skewed_join
from .repetition import words

_TAG = re.compile(r"\[[^\]]*\]")
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SIGN_BITS = 256
#: Texts sketched in step, texts of a block (their places fit 16 bits), keys of a range, pairs of a batch.
_STEP_TEXTS, _BLOCK_TEXTS, _RANGE_KEYS, _PAIRS = 128, 8192, 1_000_000, 200_000
_MEMO: dict[str, int] = {}
_MEMO_WORDS = 1_000_000


@dataclass(frozen=True)
class Similarity:
    """What counts as similar, and the banding that finds it.

    A sketch has ``size`` coordinates, a band is some ``rows`` of them; a pair
    of similarity s is a candidate with probability 1 - (1 - s^rows)^bands, a
    little less where bands share coordinates.
    """

    run: int = 5
    threshold: float = 0.8
    min_words: int = 10
    rows: int = 8
    bands: int = 64
    size: int = 512

    def layout(self) -> np.ndarray:
        """(bands, rows): the coordinates of each band, cut from as many shuffles of all coordinates as are needed."""
        rng, per = np.random.default_rng(7), self.size // self.rows
        shuffles = [rng.permutation(self.size)[: per * self.rows].reshape(per, self.rows) for _ in range(-(-self.bands // per))]
        return np.concatenate(shuffles)[: self.bands]

    @property
    def slack_bits(self) -> int:
        """Of the 256 sign bits of a pair at the threshold, differing ones beyond 5.5 standard deviations."""
        differ = (1 - self.threshold) / 2
        return int(np.ceil(_SIGN_BITS * differ + 5.5 * np.sqrt(_SIGN_BITS * differ * (1 - differ)))) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_words(text: str) -> list[str]:
    return words(_TAG.sub(" ", text))


def run_hashes(texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of ``k`` words of all texts one after the other, number of runs of each text)."""
    words_of = [w for t in texts for w in t]
    if len(_MEMO) > _MEMO_WORDS:
        _MEMO.clear()
    for w in set(words_of).difference(_MEMO):
        _MEMO[w] = xxhash.xxh3_64_intdigest(w)
    each = np.fromiter(map(_MEMO.__getitem__, words_of), dtype=np.uint64, count=len(words_of))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = max(len(each) - k + 1, 0)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h = _mix((h + _STEP) ^ each[j : j + n])
    left = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n)  # words of the same text from here on
    return h[left >= k], np.maximum(sizes - k + 1, 0)


def runs(tokens: list[str], k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``k`` words."""
    return np.unique(run_hashes([tokens], k)[0])


def sketches(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` 64-bit coordinates per non-empty set, all sets in step; the sets lie one after the other, elements may repeat."""
    n = len(counts)
    first = np.repeat(np.arange(n) * size, counts)  # place of the owner's first bin
    lowest = np.full(n * size, 2**64 - 1, dtype=np.uint64)
    in_round = np.full(n * size, -1, dtype=np.int32)
    half = np.uint64(32)
    with np.errstate(over="ignore"):
        for r in range(2 * size):
            if not len(elements):
                break
            h = _mix(elements + _STEP * np.uint64(r + 1))
            at = first + (((h >> half) * np.uint64(size)) >> half).astype(np.int64) if r < size else first + (r - size)
            free = in_round[at] < 0
            at, h = at[free], h[free]
            np.minimum.at(lowest, at, h)
            in_round[at] = r
            if r % 8 == 7:  # texts whose bins are full are done
                done = (in_round.reshape(n, size) >= 0).all(axis=1)
                if done.any():
                    rest = ~done[first // size]
                    elements, first = elements[rest], first[rest]
        # a coordinate of two sets is equal only if it was filled in the same round
        return _mix(lowest ^ (in_round.astype(np.uint64) * _STEP)).reshape(n, size)


def band_keys(sketch: np.ndarray, layout: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(1, len(layout) + 1, dtype=np.uint64) * _STEP, (len(sketch), 1))
    with np.errstate(over="ignore"):
        for j in range(layout.shape[1]):
            key = _mix(key ^ sketch[:, layout[:, j]]) + _STEP
    return key


def sign_bits(sketch: np.ndarray) -> np.ndarray:
    """256 bits of each sketch (one bit of each of 256 coordinates, repeated for short sketches) as four longs."""
    take = np.resize(np.arange(sketch.shape[1]), _SIGN_BITS)
    bits = ((sketch[:, take] >> np.uint64(33)) & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">i8").astype(np.int64)


@pandas_udf(T.StructType([T.StructField("n_words", T.IntegerType()), T.StructField("class_key", T.StringType())]))
def _classed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            w = text_words(t) if t else []
            rows.append((len(w), blake2b(" ".join(w).encode(), digest_size=16).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_words", "class_key"])


_BLOCKS = "range int, base bigint, keys binary, places binary"


def _blocks(how: Similarity, ranges: int):
    """Texts (id, text) to blocks: the band keys (32 bits, the rest is their range) and the places of their texts from ``base`` on.

    Blocks of a negative range have the signs of some texts instead of keys.
    """
    layout = how.layout()

    def pack(ids: np.ndarray, sketched: list[np.ndarray], signs: list[np.ndarray]) -> pa.RecordBatch:
        base = int(ids[0])
        keys = np.concatenate(sketched).ravel()
        of = ((keys >> np.uint64(32)) % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
        order = np.argsort(of, kind="stable")
        low = keys.astype(np.uint32)[order]
        place = (ids - base).astype(np.uint16)[order // len(layout)]
        there, start = np.unique(of[order], return_index=True)
        end = np.append(start[1:], len(order))
        columns = [
            pa.array([int(r) for r in there] + [-1 - base // _BLOCK_TEXTS % ranges], pa.int32()),
            pa.array([base] * (len(there) + 1), pa.int64()),
            pa.array([low[a:b].tobytes() for a, b in zip(start, end)] + [np.concatenate(signs).tobytes()], pa.binary()),
            pa.array([place[a:b].tobytes() for a, b in zip(start, end)] + [(ids - base).astype(np.uint16).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["range", "base", "keys", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sketched: list[np.ndarray] = []
        signs: list[np.ndarray] = []
        for batch in batches:
            new, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(new):
                # ids are consecutive within a file; where they are not, or the block is full, it ends
                if ids and (new[at] < ids[-1] or new[at] - ids[0] >= _BLOCK_TEXTS):
                    yield pack(np.array(ids), sketched, signs)
                    ids, sketched, signs = [], [], []
                base = ids[0] if ids else new[at]
                end = at + 1
                while end < len(new) and end - at < _STEP_TEXTS and 0 < new[end] - new[end - 1] and new[end] - base < _BLOCK_TEXTS:
                    end += 1
                sk = sketches(*run_hashes([text_words(t) for t in texts[at:end]], how.run), how.size)
                ids += new[at:end]
                sketched.append(band_keys(sk, layout))
                signs.append(sign_bits(sk))
                at = end
        if ids:
            yield pack(np.array(ids), sketched, signs)

    return run


def meeting(keys: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids of equal key, by distance in the order of keys."""
    order = (keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    keys, ids = order >> np.uint64(32), ids[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    apart = 1
    live = np.flatnonzero(keys[1:] == keys[:-1])
    while len(live):
        yield ids[live], ids[live + apart]
        apart += 1
        live = live[live + apart < len(keys)]
        live = live[keys[live + apart] == keys[live]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of range to pairs of texts (a < b) and, with null b, the signs of texts."""
    names = ["a", "b", "s0", "s1", "s2", "s3"]

    def pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for a, b in meeting(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held])) if held else ():
            waiting.append(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b])
            n += len(a)
            if n >= _PAIRS:
                yield out(np.concatenate(waiting, axis=1))
                waiting, n = [], 0
        if n:
            yield out(np.concatenate(waiting, axis=1))

    def out(both: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(both.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), empty, empty, empty, empty], names)

    now, held = None, []
    for batch in batches:
        for r, base, keys, places in zip(*(c.to_pylist() for c in batch.columns)):
            ids = base + np.frombuffer(places, dtype=np.uint16).astype(np.int64)
            if r < 0:
                signs = np.frombuffer(keys, dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), *(pa.array(signs[:, k]) for k in range(4))], names)
                continue
            if r != now:
                yield from pairs(held)
                now, held = r, []
            held.append((np.frombuffer(keys, dtype=np.uint32), ids))
    yield from pairs(held)


def _run_sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows.id.values, "runs": [runs(text_words(t), k).view(np.int64) for t in rows.text]})

    return run


def similar_classes(records: DataFrame, record_id: str, text: str, how: Similarity) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    ``members``: record_id, rep; every record of at least ``min_words`` words
    and one run, with the representative (smallest record_id) of the records
    that have its word sequence.  ``links``: a < b, similarity; pairs of
    representatives of at least the threshold.  Repeated rows of a record_id
    count once (the longest text).  Null, empty and short texts are in neither.
    """
    once = records.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text")).where(F.col("record_id").isNotNull() & F.col("text").isNotNull())
    least = max(how.min_words, how.run)
    # of several texts of a record the longest counts, here and below by the same order
    length, tie = F.length("text").alias("length"), F.xxhash64("text").alias("tie")
    known = once.select("record_id", length, tie, _classed("text").alias("c"))
    best = known.groupBy("record_id").agg(F.max(F.struct("length", "tie", "c")).alias("m"))
    best = materialize(best.where(F.col("m.c.n_words") >= least).select("record_id", F.col("m.c.class_key").alias("class_key")), "classes")
    reps = best.groupBy("class_key").agg(F.min("record_id").alias("rep"))
    members = materialize(skewed_join(best, reps, ["class_key"], F.col("record_id")).select("record_id", "rep"), "members")
    discard(best)

    own = members.where(F.col("record_id") == F.col("rep")).select("rep")
    texts = once.withColumnRenamed("record_id", "rep").join(own, "rep", "left_semi")
    texts = texts.groupBy("rep").agg(F.max(F.struct(length, tie, "text")).alias("m")).select("rep", F.col("m.text").alias("text"))
    # ids of eight bytes for the wide shuffle; written, so that they stay
    texts = materialize(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    parts = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(4 * parts, -(-texts.count() * how.bands // _RANGE_KEYS))
    blocks = texts.select("id", "text").mapInArrow(_blocks(how, ranges), _BLOCKS)
    blocks = blocks.repartition(max(parts, ranges // 4), "range").sortWithinPartitions("range")
    found = materialize(blocks.mapInArrow(_met, "a bigint, b bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"), "met")
    met = materialize(found.where("b is not null").select("a", "b").distinct(), "pairs")
    sign = ["s0", "s1", "s2", "s3"]
    signs = found.where("b is null").select(F.col("a").alias("id"), *sign)
    signed = skewed_join(met, signs.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in sign]), ["a"], F.col("b"))
    signed = skewed_join(signed, signs.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in sign]), ["b"], F.col("a"), counted=met)
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in sign[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    near = materialize(signed.where(differ <= how.slack_bits).select("a", "b"), "candidates")
    discard(found, met)

    needed = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    sets = materialize(texts.join(needed, "id", "left_semi").mapInPandas(_run_sets(how.run), "id bigint, runs array<bigint>"), "runs")
    exact = skewed_join(near, sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), ["a"], F.col("b"))
    exact = skewed_join(exact, sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), ["b"], F.col("a"), counted=near)
    shared = F.size(F.array_intersect("ra", "rb"))
    exact = exact.select("a", "b", shared.alias("shared"), (F.size("ra") + F.size("rb")).alias("both"))
    exact = exact.withColumn("similarity", F.col("shared") / (F.col("both") - F.col("shared")))
    links = materialize(exact.where(F.col("similarity") >= how.threshold).select("a", "b", "similarity"), "linked")
    named = texts.select("id", "rep")
    x, y = named.select(F.col("id").alias("a"), F.col("rep").alias("x")), named.select(F.col("id").alias("b"), F.col("rep").alias("y"))
    linked = skewed_join(skewed_join(links, x, ["a"], F.col("b")), y, ["b"], F.col("a"), counted=links)
    links = materialize(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"), "links")
    discard(texts, sets, near)
    return members, links


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of records that are copies or whose classes are linked."""
    left = members.select(F.col("record_id").alias("x"), F.col("rep").alias("a"))
    right = members.select(F.col("record_id").alias("y"), F.col("rep").alias("b"))
    across = skewed_join(links.select("a", "b"), left, ["a"], F.col("b"))
    across = across.join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # the records of a hot class are spread, each meeting all of the class
    copies = skewed_join(left, right.withColumnRenamed("b", "a"), ["a"], F.col("x")).where(F.col("x") < F.col("y"))
    return across.unionByName(copies.select(F.col("x").alias("a"), F.col("y").alias("b")))


def with_all_records(members: DataFrame, records: DataFrame, record_id: str) -> DataFrame:
    """The members and every other record_id of ``records``, whose text is null, empty or short, as its own rep."""
    ids = records.select(F.col(record_id).cast("string").alias("record_id")).where("record_id is not null").distinct()
    return ids.join(members, "record_id", "left").select("record_id", F.coalesce("rep", "record_id").alias("rep"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per member: record_id, rep, group_id, n_links.

    group_id is the smallest record_id that links lead to, n_links the number
    of other texts the record's text is linked to.  Labels spread along links
    and then jump to their label's label, so the rounds are about the
    logarithm of the longest chain; each round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, "edges")
    labels = materialize(both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")), "labels")
    while True:
        of_b = labels.select(F.col("v").alias("b"), F.col("label").alias("other"))
        least = skewed_join(both, of_b, ["b"], F.col("a")).groupBy(F.col("a").alias("v")).agg(F.min("other").alias("other"))
        step = labels.join(least, "v").select("v", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        step = materialize(step, "step")
        up = step.select(F.col("v").alias("label"), F.col("label").alias("up"))
        further = materialize(skewed_join(step, up, ["label"], F.col("v")).select("v", "was", F.least("label", "up").alias("label")), "labels")
        discard(labels, step)
        labels = further
        if not labels.where(F.col("was") != F.col("label")).take(1):
            break
        labels = labels.select("v", "label")
    degree = both.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
    found = labels.select(F.col("v").alias("rep"), F.col("label").alias("group_id")).join(degree, "rep")
    out = skewed_join(members, found, ["rep"], F.col("record_id"), "left")
    return out.select("record_id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
