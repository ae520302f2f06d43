import random
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import packing as p

pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, ids array<int>, piece int, rare int, container_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, [1], 3, 4, "c") for i, t in rows], DOCS)


def check(packed, sizes, capacity):
    """Everything is in exactly once, nothing overflows, nothing is split that need not be."""
    boxes, spans = defaultdict(int), defaultdict(list)
    for r in packed:
        boxes[r.container_id] += r.n_tokens
        spans[r.doc_id].append((r.start_token, r.n_tokens, r.piece))
    assert max(boxes.values(), default=0) <= capacity
    assert set(spans) == set(sizes)
    for doc, size in sizes.items():
        at = 0
        for k, (start, n, piece) in enumerate(sorted(spans[doc], key=lambda x: x[2])):
            assert (start, piece) == (at, k)
            at += n
        assert at == size and len(spans[doc]) == max(1, -(-size // capacity))
    return boxes


def test_every_document_is_in_once(spark):
    rng = random.Random(2)
    rows = [(i, " hello" * rng.choice([0, 1, 5, 30, 60, 100, 128, 129, 256, 300])) for i in range(200)] + [(1000, None), (1001, "")]
    packed = p.pack(frame(spark, rows), capacity=128, shard_items=64).collect()
    sizes = {i: (t or "").count("hello") for i, t in rows}
    boxes = check(packed, sizes, 128)
    assert sum(boxes.values()) / (128 * len(boxes)) > 0.85
    slots = defaultdict(list)
    for r in packed:
        slots[r.container_id].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table_and_only_empty_texts(spark):
    assert p.pack(frame(spark, [])).count() == 0
    packed = p.pack(frame(spark, [(i, None) for i in range(5)])).collect()
    check(packed, dict.fromkeys(range(5), 0), p.CAPACITY)


def test_very_long_text(spark):
    packed = p.pack(frame(spark, [(1, " a" * 50_000), (2, "b")])).collect()
    check(packed, {1: 50_000, 2: 1}, 2048)


def test_neighbours_are_lexical():
    a, b = np.arange(100, 120), np.arange(500, 520)
    items = [a, b, a[:15], b[:15], np.array([], dtype=np.int32)]
    index = p.ShardIndex(items, p.Corpus.of(items))
    assert list(index.neighbours(0)) == [0, 2] and list(index.neighbours(1)) == [1, 3] and list(index.neighbours(4)) == []


def test_shard_prefers_neighbours_and_fills():
    rng = np.random.default_rng(3)
    items = [rng.integers(topic * 1000, topic * 1000 + 50, size=int(rng.integers(5, 60))) for topic in range(4) for _ in range(50)]
    boxes = p.pack_shard(items, 200)
    assert sorted(i for b in boxes for i in b) == list(range(200))
    used = [sum(len(items[i]) for i in b) for b in boxes]
    assert max(used) <= 200 and sum(used) / (200 * len(boxes)) > 0.95
    same = sum(len({i // 50 for i in b}) <= 2 for b in boxes)
    assert same > len(boxes) / 2


def test_scores_are_bm25_of_the_whole_corpus():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 60, size=int(rng.integers(1, 80))) for _ in range(40)]
    corpus = p.Corpus.of(items)
    index = p.ShardIndex(items[:20], corpus)
    mean = np.mean([len(i) for i in items])
    df = {t: sum(t in i for i in items) for t in range(60)}

    def score(seed, other):
        total = 0.0
        for t in set(items[seed].tolist()):
            tf = int((items[other] == t).sum())
            total += np.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(items[other]) / mean))
        return total

    for seed in range(20):
        want = sorted((i for i in range(20) if score(seed, i) > 0), key=lambda i: (-round(score(seed, i), 9), i))
        assert index.neighbours(seed).tolist() == want
    index.forget(np.arange(20) % 2 == 0)
    assert index.neighbours(0).tolist() == [i for i in sorted(range(20), key=lambda i: (-round(score(0, i), 9), i)) if i % 2 and score(0, i) > 0]


def test_corpus_and_keys(spark):
    rows = [(i, " hello" * 3 + " world" * (i % 2) + f" {i}") for i in range(30)] + [(100, None)]
    items = p.token_pieces(frame(spark, rows), 64)
    corpus = p.corpus_of(items)
    assert corpus.n == 31 and max(corpus.frequencies) == 30
    keyed = p._keyed(items, corpus, 20).collect()
    assert all(x.k1 is None or 2 <= corpus.frequencies[x.k1] <= 20 for x in keyed)
    assert next(x for x in keyed if x.doc_id == 100).k1 is None


def test_string_ids_and_hot_tokens(spark):
    rows = [(f"d{i:03d}", " same words in all" * 4) for i in range(150)] + [(None, " lost")]
    packed = p.pack(spark.createDataFrame(rows, "doc_id string, text string"), capacity=64, shard_items=16).collect()
    assert sorted(x.doc_id for x in packed if x.doc_id) == [f"d{i:03d}" for i in range(150)] and len(packed) == 151


def test_fill_report_and_oversized(spark):
    rows = [(1, " a" * 300), (2, " b" * 100), (3, ""), (4, " c" * 128)]
    packed = p.pack(frame(spark, rows), capacity=128)
    report = p.fill_report(packed, 128).first()
    assert (report.documents, report.over_capacity, report.broken, report.tokens) == (4, 0, 0, 528)
    assert [x.doc_id for x in p.oversized(packed, 128).collect()] == [1]
    bad = spark.createDataFrame([("x", 0, 1, 1, 128, 9), ("x", 1, 2, 0, 0, 200)], packed.schema)
    report = p.fill_report(bad, 128).first()
    assert (report.over_capacity, report.broken) == (1, 1)
    assert p.fill_report(p.pack(frame(spark, []))).first().documents == 0


def test_repeated_ids_and_ties():
    items = [np.full(10, 7)] * 40
    boxes = p.pack_shard(items, 100)
    assert sorted(len(b) for b in boxes) == [10] * 4
    assert p.pack_shard(items, 100) == boxes
