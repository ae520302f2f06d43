import math
from datetime import datetime

import pytest

from quillspark.llm import ranking as r

HITS = "query_id bigint, arm string, song_id string, score double, best_chunk_id string, scored_at timestamp_ntz, x double, rank int"
CONFIGS = "arm string, higher_is_better boolean, mode string"
ARMS = [("cos", True, "dense"), ("l2", False, "dense"), ("bm25", True, "lexical")]


def at(n):
    return datetime(2026, 1, 1, 0, 0, n)


def rank(spark, rows, arms=ARMS):
    full = [(q, a, s, x, None, at(t), 0.0, 0) for q, a, s, x, t in rows]
    scores = r.latest_scores(spark.createDataFrame(full, HITS), spark.createDataFrame(arms, CONFIGS))
    return r.ideal_point_scores(scores)


def order(spark, rows, query=1):
    return [x.song_id for x in sorted(r.full_ranking(rank(spark, rows)).where(f"query_id = {query}").collect(), key=lambda x: x["rank"])]


def test_range_does_not_decide(spark):
    """a is best in two arms of small range; b is far ahead in one of huge range."""
    rows = [(1, "cos", s, v, 1) for s, v in zip("abcdef", (0.9, 0.5, 0.4, 0.35, 0.3, 0.2))]
    rows += [(1, "l2", s, v, 1) for s, v in zip("abcdef", (0.1, 0.6, 0.7, 0.72, 0.8, 0.9))]
    rows += [(1, "bm25", s, v, 1) for s, v in zip("abcdef", (30.0, 90_000.0, 20.0, 15.0, 12.0, 10.0))]
    assert order(spark, rows)[0] == "a"


def test_scale_and_shift_change_nothing(spark):
    base = [(1, "cos", s, v, 1) for s, v in zip("abcde", (0.9, 0.7, 0.65, 0.3, 0.1))] + [(1, "bm25", s, v, 1) for s, v in zip("abcde", (3.0, 9.0, 5.0, 4.0, 1.0))]
    moved = [(q, a, s, v if a == "cos" else v * 1e6 - 5e7, t) for q, a, s, v, t in base]
    assert order(spark, base) == order(spark, moved)


def test_latest_counts_and_unusable_scores_drop_out(spark):
    rows = [(1, "cos", "a", 0.1, 2), (1, "cos", "a", 0.99, 1), (1, "cos", "b", 0.5, 1), (1, "cos", "c", None, 2), (1, "cos", "c", 1.0, 1), (1, "cos", "d", math.nan, 1), (2, "cos", "z", None, 1)]
    assert order(spark, rows) == ["b", "a"]


def test_ties_repeated_rows_and_single_songs(spark):
    rows = [(1, "cos", s, 0.5, 1) for s in "cab"] * 2 + [(2, "l2", "only", 3.0, 1)]
    got = rank(spark, rows).collect()
    assert all(x.closeness == 0 for x in got) and len(got) == 4
    first = {x.query_id: x.song_id for x in r.first_songs(rank(spark, rows)).collect()}
    assert first == {1: "a", 2: "only"}


def test_missing_song_has_the_worst_value_of_a_list(spark):
    rows = [(1, "cos", "a", 0.9, 1), (1, "cos", "b", 0.8, 1), (1, "cos", "c", 0.1, 1), (1, "bm25", "b", 9.0, 1), (1, "bm25", "c", 1.0, 1)]
    assert order(spark, rows) == ["b", "a", "c"]


def test_infinite_scores_unknown_arms_and_empty_tables(spark):
    rows = [(1, "new", "a", math.inf, 1), (1, "new", "b", 2.0, 1), (1, "new", "c", 1.0, 1), (1, "new", "d", 0.5, 1), (1, "new", "e", 0.4, 1)]
    assert order(spark, rows)[0] == "a"
    assert rank(spark, []).count() == 0


def test_closeness_by_hand(spark):
    rows = [(1, "cos", "a", 1.0, 1), (1, "cos", "b", 0.5, 1), (1, "cos", "c", 0.0, 1), (1, "bm25", "a", 0.0, 1), (1, "bm25", "b", 2.0, 1), (1, "bm25", "c", 1.0, 1)]
    got = {x.song_id: x.closeness for x in rank(spark, rows).collect()}
    assert got["a"] == pytest.approx(0.5)
    assert got["b"] == pytest.approx(math.hypot(0.5, 1) / (math.hypot(0.5, 1) + 0.5))
    assert got["c"] == pytest.approx(0.5 / (0.5 + math.hypot(1, 0.5)))


def test_one_query_with_most_rows(spark):
    rows = [(1, "cos", f"s{i:04d}", i / 1000, 1) for i in range(1000)] + [(2, "cos", "x", 1.0, 1)]
    assert order(spark, rows) == [f"s{i:04d}" for i in range(999, -1, -1)]


def test_hot_queries_give_the_same(spark):
    import random

    rng = random.Random(4)
    rows = [(q, a, f"s{i}", rng.choice([rng.gauss(0, 1), 0.5, rng.gauss(0, 40)]), 1) for q in (1, 2) for a, _, _ in ARMS for i in range(rng.randint(1, 60))]
    rows += [(2, "cos", "inf", math.inf, 1), (2, "cos", "low", -math.inf, 1)]
    full = [(q, a, s, x, None, at(t), 0.0, 0) for q, a, s, x, t in rows]
    scores = r.latest_scores(spark.createDataFrame(full, HITS), spark.createDataFrame(ARMS, CONFIGS))
    plain = {tuple(x) for x in r.ideal_point_scores(scores).collect()}
    assert plain == {tuple(x) for x in r.ideal_point_scores(scores, hot_rows=10).collect()} and len(plain) > 20


def test_quartiles_all_infinite(spark):
    rows = [(1, "cos", s, v, 1) for s, v in zip("abcde", (math.inf, math.inf, math.inf, 1.0, 0.0))] + [(2, "cos", s, math.inf, 1) for s in "ab"]
    got = {(x.query_id, x.song_id): x.closeness for x in rank(spark, rows).collect()}
    assert got[1, "a"] == got[1, "d"] == 1 and got[1, "e"] == 0 and got[2, "a"] == got[2, "b"] == 0


def test_uneven_lists_by_hand(spark):
    """The vector norm of cos is sqrt(1.25), that of bm25 sqrt(2)."""
    rows = [(1, "cos", "a", 1.0, 1), (1, "cos", "b", 0.5, 1), (1, "cos", "c", 0.0, 1), (1, "bm25", "a", 0.0, 1), (1, "bm25", "b", 2.0, 1), (1, "bm25", "c", 2.0, 1)]
    got = {x.song_id: x.closeness for x in rank(spark, rows).collect()}
    i, k = 1 / math.sqrt(1.25), 1 / math.sqrt(2)
    assert got["a"] == pytest.approx(i / (i + k))
    assert got["b"] == pytest.approx(math.hypot(i / 2, k) / (math.hypot(i / 2, k) + i / 2))
