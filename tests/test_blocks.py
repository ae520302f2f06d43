"""Searches over blocks of documents, against a full computation; no shuffle of pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import blocks as bl
from quillspark.operators import postings as inv
from quillspark.operators import retrieval


@pytest.fixture(scope="module")
def texts(spark):
    """Songs of few words, so that scores are often equal, some repeated, empty or null; chunks are their halves."""
    rng = random.Random(7)
    words = "a the song about red river harbor quiet lantern rare".split()
    songs = [(f"s{i:04d}", " ".join(rng.choice(words) for _ in range(rng.randint(2, 6)))) for i in range(400)]
    songs += [("t1", ""), ("t2", None), *[(f"u{i:03d}", "red river") for i in range(120)]]
    chunks = [(f"{i}:{j}", i, j, part) for i, t in songs if t for j, part in enumerate((t[: len(t) // 2], t[len(t) // 2 :]))]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(60, "  "), (61, "unheard"), (62, None), (63, "red red river")]
    return spark.createDataFrame(songs, "song_id string, text_raw string"), spark.createDataFrame(chunks, "chunk_id string, song_id string, position int, text string"), spark.createDataFrame(queries, "query_id bigint, query string")


def best(scores, k):
    return sorted(((-s, d) for d, s in scores.items() if s > 0))[:k]


@pytest.mark.parametrize("least", [1024, 5])
def test_lexical_equals_all_pairs(spark, texts, monkeypatch, least):
    monkeypatch.setattr(bl, "LEAST_QUERIES", least)
    songs, chunks, queries = texts
    model = retrieval.fit_lexical(songs)
    bag = inv.query_bag(queries.where(~retrieval.is_blank(F.col("query"))), "query_id", tx.tokenize_words(F.col("query")))
    want = {}
    for r in inv.bm25_scores(bag, "query_id", model, "song_id").collect():
        want.setdefault(r.query_id, {})[r.song_id] = math.floor(r.score * 1e6 + 0.5) / 1e6
    got = {}
    for r in retrieval.lexical_search(queries, songs, chunks, 10)[0].collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.song_id))
    assert {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()} == {q: best(s, 10) for q, s in want.items() if best(s, 10)}


def test_dense_equals_all_pairs(spark, texts, monkeypatch):
    monkeypatch.setattr(bl, "LEAST_QUERIES", 9)
    _, chunks, queries = texts
    terms = tx.tfidf_terms(F.col("text"))
    model = inv.fit_tfidf(chunks, "chunk_id", terms)
    q = inv.tfidf_vectors(queries, "query_id", tx.tfidf_terms(F.col("query")), model)
    want = {}
    for r in inv.sparse_scores(q, "query_id", inv.tfidf_vectors(None, "chunk_id", terms, model), "chunk_id").collect():
        want.setdefault(r.query_id, {})[r.chunk_id] = round(r.score, 6)
    got = {}
    for r in retrieval.sparse_chunks(queries, chunks, 10)[0].collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.chunk_id))
    assert {x: [y[1:] for y in sorted(rows)] for x, rows in got.items()} == {x: best(s, 10) for x, s in want.items()}


def test_lexical_statuses_without_a_search(spark, texts):
    songs, chunks, queries = texts
    rows = lambda df: sorted(df.collect())
    assert rows(retrieval.lexical_statuses(queries, songs)) == rows(retrieval.lexical_search(queries, songs, chunks)[1])


def test_statuses_need_the_best_hit_only(spark, texts):
    songs, chunks, queries = texts

    def statuses(k, c):
        return sorted((r.query_id, r.status, *sorted(r.branch_statuses.items())) for r in retrieval.hybrid(retrieval.dense_sparse_search(queries, chunks, k), retrieval.lexical_search(queries, songs, c, k))[1].collect())

    assert statuses(1, None) == statuses(50, chunks)


def test_empty_tables(spark, texts):
    songs, chunks, queries = texts
    assert retrieval.lexical_search(queries, songs.limit(0), chunks.limit(0))[0].count() == 0
    assert retrieval.dense_sparse_search(queries.limit(0), chunks)[0].count() == 0


@pytest.mark.parametrize("name", ["lexical_search", "dense_search", "shown_results"])
def test_all_queries_are_searched(spark, tables, name):
    """Not those alone whose id is divisible by 20."""
    from quillspark.queries import ORACLES, QUERIES

    found = [r.query_id for r in QUERIES[name](spark, tables).select("query_id").distinct().collect()]
    assert any(q % 20 for q in found)
    assert "% 20" not in ORACLES[name]
