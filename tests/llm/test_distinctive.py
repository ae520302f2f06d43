import math

import pytest

from quillspark.llm import distinctive as d

CHUNKS = "chunk_id string, text string, term string, m int, observed int"
QUERIES = "query_id bigint, query string, source_chunk_id string, chunk_id string, term string"


def run(spark, chunks, queries):
    c = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in chunks], CHUNKS)
    q = spark.createDataFrame([(i, t, s, "other", "y") for i, t, s in queries], QUERIES)
    return d.shared_terms(q, c)


CORPUS = [("a", "the cat and the dog"), ("b", "the Cat sat"), ("c", "rare gem, the"), ("c", "rare gem, the"), ("d", None), ("e", " "), (None, "the")]


def test_by_hand(spark):
    rows = {r.term: r for r in run(spark, CORPUS, [(1, "The rare GEM a", "c")]).collect()}
    assert set(rows) == {"the", "rare", "gem"}
    assert rows["the"].n_occurrences == 4 and rows["the"].n_records == 3 and rows["the"].total_records == 5
    total, r, c = 11, 3, 1
    e = r * c / total
    assert rows["rare"].residual == pytest.approx((1 - e) / math.sqrt(e * (1 - r / total) * (1 - c / total)))
    assert rows["rare"].residual > rows["the"].residual
    assert rows["gem"].idf == pytest.approx(math.log(6 / 2) + 1)


def test_rare_terms_and_summary(spark):
    shared = run(spark, CORPUS, [(1, "the rare gem", "c"), (1, "the rare gem", "c"), (2, "sat cat", "b")])
    rare = {r.query_id: r for r in d.rare_shared_terms(shared, 0.2).collect()}
    assert {q: r.terms for q, r in rare.items()} == {1: ["gem", "rare"], 2: ["sat"]} and rare[1].residuals[0] == rare[1].residuals[1] > 0
    more = {r.query_id: r for r in d.rare_shared_terms(shared, 1.0).collect()}
    assert more[1].terms == ["gem", "rare", "the"] and sorted(more[1].residuals, reverse=True) == more[1].residuals
    got = {r.query_id: r for r in d.leak_summary(shared).collect()}
    assert got[1].shared == ["gem", "rare", "the"] and got[1].top_term == "gem" and got[2].top_term == "sat"


def test_edge_rows(spark):
    queries = [(1, None, "a"), (2, "", "a"), (3, "?!", "a"), (4, "cat", None), (5, "cat", "missing"), (6, "cat", "d"), (None, "cat", "a")]
    assert run(spark, CORPUS, queries).count() == 0
    assert run(spark, [], [(1, "cat", "a")]).count() == 0
    assert run(spark, CORPUS, []).count() == 0


def test_single_word_corpus_has_no_variance(spark):
    assert [r.residual for r in run(spark, [("a", "only")], [(1, "only", "a")]).collect()] == [0.0]


def test_very_long_text(spark):
    (row,) = run(spark, [("a", "word " * 200_000), ("b", "x")], [(1, "word", "a")]).collect()
    assert row.observed == 200_000


def test_one_term_in_most_queries(spark):
    queries = [(i, "hot cat", "b") for i in range(500)]
    assert run(spark, CORPUS + [("h", "hot")], queries).count() == 500
