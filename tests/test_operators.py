"""Fusion, retrieval, vectors, metrics, leaks, pools: small cases with known results."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import metrics as m
from quillspark.operators import evaluation, fusion, gate, ingest, knn, leak, pooling, retrieval
from quillspark.operators import embedders as emb
from quillspark.operators import postings as inv
from quillspark.functions import text as tx
from quillspark.queries import evaluation as queries
from quillspark.queries import search
from quillspark.runtime import counted_join, discard, hot_keys, materialize, ranked, salted_join, skewed_join


def rrf(lists, k=60):
    found = {}
    for items in lists:
        for place, x in enumerate(items, 1):
            s, n, best = found.get(x, (0.0, 0, 10**9))
            found[x] = (s + 1 / (k + place), n + 1, min(best, place))
    return sorted(found, key=lambda x: (-round(found[x][0], 12), -found[x][1], found[x][2], x))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abcdefgh"), unique=True, max_size=8), min_size=1, max_size=4), min_size=20, max_size=40))
def test_fusion_against_a_plain_count(spark, cases):
    rows = [(q, f"arm{a}", x, i) for q, lists in enumerate(cases) for a, items in enumerate(lists) for i, x in enumerate(items, 1)]
    df = spark.createDataFrame(rows, "query_id int, arm string, song_id string, rank int")
    got = {}
    for r in fusion.reciprocal_rank_fusion(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.song_id)
    assert got == {q: rrf(lists) for q, lists in enumerate(cases) if any(lists)}


def test_equal_scores_prefer_more_lists(spark):
    """With k = 48 and fifty places, two last places equal one first place."""
    rows = [(1, "a", "both", 50), (1, "b", "both", 50), (1, "a", "one", 1)]
    df = spark.createDataFrame(rows, "query_id int, arm string, song_id string, rank int")
    assert [r.song_id for r in fusion.reciprocal_rank_fusion(df, k=48).orderBy("rank").collect()] == ["both", "one"]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(df, k=-1)


def test_best_chunk_wins_ties_by_id(spark):
    rows = [(1, "s:1", "s", 0.5), (1, "s:0", "s", 0.5), (1, "t:0", "t", 0.9), (1, "t:1", "t", 0.1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, song_id string, score double")
    assert {(r.song_id, r.score, r.best_chunk_id) for r in fusion.best_chunk_per_song(df).collect()} == {("s", 0.5, "s:0"), ("t", 0.9, "t:0")}
    assert {(r.song_id, round(r.score, 6)) for r in fusion.mean_per_song(df).collect()} == {("s", 0.5), ("t", 0.5)}


def test_ranked_numbers_every_group(spark):
    rows = [("hot", i) for i in range(2000)] + [("x", 1), ("x", 0), (None, 5)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r.g, r.v): r["rank"] for r in ranked(df, ["g"], [F.desc("v")]).collect()}
    assert all(got["hot", i] == 2000 - i for i in range(2000)) and got["x", 1] == 1 and got["x", 0] == 2 and got[None, 5] == 1


def test_salted_join_is_a_join(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, i int")
    small = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "k string, x double")
    assert salted_join(big, small, ["k"], F.col("i")).count() == 50
    assert salted_join(big, small, ["k"], F.col("i"), "left").count() == 52


SONGS = [("s1", "red river flows down"), ("s2", "blue sky and red sun"), ("s3", "green grass"), ("s4", "")]
CHUNKS = [("s1:0", "s1", 0, "red river"), ("s1:1", "s1", 1, "flows down"), ("s2:0", "s2", 0, "blue sky"), ("s2:1", "s2", 1, "and red sun"), ("s3:0", "s3", 0, "green grass")]
QUERIES = [(1, "red river red"), (2, "  "), (3, "zzz"), (4, None), (5, "grass")]


@pytest.fixture(scope="module")
def corpus(spark):
    songs = spark.createDataFrame(SONGS, "song_id string, text_raw string")
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, song_id string, position int, text string")
    return songs, chunks, spark.createDataFrame(QUERIES, "query_id int, query string")


def bm25(query, songs):
    docs = {i: t.lower().split() for i, t in songs}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    return {i: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split()) for i, d in docs.items()}


def test_lexical(spark, corpus):
    songs, chunks, queries = corpus
    hits, status = retrieval.lexical_search(queries, songs, chunks)
    want = bm25("red river red", SONGS)
    got = {r.song_id: (r.score, r.best_chunk_id) for r in hits.where("query_id = 1").collect()}
    assert got == {"s1": (round(want["s1"], 6), "s1:0"), "s2": (round(want["s2"], 6), "s2:1")} or want["s2"] == 0
    assert {r.query_id: (r.status, r.query_norm) for r in status.collect()} == {1: ("ok", 3), 2: ("empty_query", 0), 3: ("query_out_of_vocabulary", 0), 4: ("empty_query", 0), 5: ("ok", 1)}


def test_song_without_chunks(spark, corpus):
    songs, chunks, queries = corpus
    some = chunks.where("song_id <> 's3'")
    assert retrieval.lexical_search(queries, songs, some)[0].where("query_id = 5").first().best_chunk_id is None
    with pytest.raises(Exception, match="song without chunks"):
        retrieval.lexical_search(queries, songs, some, on_missing_chunk="error")[0].collect()


def test_hybrid_statuses(spark, corpus):
    songs, chunks, queries = corpus
    hits, status = retrieval.hybrid(retrieval.dense_sparse_search(queries, chunks), retrieval.lexical_search(queries, songs, chunks))
    got = {r.query_id: r for r in status.collect()}
    assert {q: r.status for q, r in got.items()} == {1: "ok", 2: "empty_query", 3: "query_out_of_vocabulary", 4: "empty_query", 5: "ok"}
    assert got[3].branch_statuses == {"dense": "query_out_of_vocabulary", "lexical": "query_out_of_vocabulary"}
    first = hits.where("query_id = 1 and rank = 1").first()
    assert first.song_id == "s1" and first.n_lists == 2 and first.best_chunk_id == "s1:0"


def test_limit_is_on_chunks(spark, corpus):
    _, chunks, queries = corpus
    hits, _ = retrieval.dense_sparse_search(queries, chunks, k=1)
    assert hits.where("query_id = 1").count() == 1


def test_out_of_sync_index_raises(spark, corpus):
    hits = spark.createDataFrame([(1, "gone:0", 1.0)], "query_id int, chunk_id string, score double")
    with pytest.raises(Exception, match="out of sync"):
        retrieval.require_chunks(hits, corpus[1]).collect()


def test_tfidf_rows_are_unit_and_dims_are_the_vocabulary(spark, corpus):
    _, chunks, _ = corpus
    model = inv.fit_tfidf(chunks, "chunk_id", tx.tfidf_terms(F.col("text")))
    v = inv.tfidf_vectors(chunks, "chunk_id", tx.tfidf_terms(F.col("text")), model)
    assert all(abs(r.n - 1) < 1e-9 for r in v.groupBy("chunk_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())
    assert model.totals.first().n_terms == 10
    assert inv.fit_tfidf(chunks, "chunk_id", tx.tfidf_terms(F.col("text")), 1).idf.first().term == "red"


def vectors(spark, n=300, dim=16, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, dim)).astype("f4")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"c{i:03d}", f"s{i % 7}", x.tolist()) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "chunk_id string, song_id string, embedding array<float>")


def test_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "ITEM_BLOCK", 50)
    v, df = vectors(spark)
    q = df.where("chunk_id < 'c020'").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {}
    for r in knn.exact_top_k(q, df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    assert got == {f"c{i:03d}": [f"c{j:03d}" for j in sorted(range(300), key=lambda j: (-s[i, j], j))[:5]] for i in range(20)}


def recall(q, df, near, k=10):
    """With and without the query's own vector, which every index finds."""
    o = knn.overlap(knn.exact_top_k(q, df, k), near).agg(F.sum("n_shared"), F.sum("n_a"), F.count_distinct("query_id")).first()
    return o[0] / o[1], (o[0] - o[2]) / (o[1] - o[2])


def test_approximate_neighbours_recall(spark):
    v, df = vectors(spark, 600)
    q = df.where("chunk_id < 'c030'").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert min(recall(q, df, knn.approximate_top_k(q, df, 10))) >= 0.9


def test_registered_approximate_search_recall(spark, tables):
    """The defaults, on the 64-dimensional tables, with and without the query's own vector."""
    for d in (tables, tables.replace("sf0.001", "sf0.01"), tables.replace("sf0.001", "sf0.1")):
        q, v = search._vectors(spark, d)
        assert min(recall(q, v, knn.approximate_top_k(q, v, 10))) >= 0.9
        assert search.approximate_overlap(spark, d).first().recall_reached


def test_lists_part_clusters(spark, tmp_path):
    """In clustered vectors few lists are probed, and the index is read back as it was written."""
    rng = np.random.default_rng(3)
    at = rng.standard_normal((20, 16)) * 6
    v = (at[rng.integers(0, 20, 1000)] + rng.standard_normal((1000, 16)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(f"c{i:04d}", "s", x.tolist()) for i, x in enumerate(v)], "chunk_id string, song_id string, embedding array<float>")
    lists = knn.fit_lists(df)
    assert lists.probes <= 6 < 30 < len(lists.centroids)
    path = str(tmp_path / "lists")
    knn.save_lists(spark, lists, knn.list_blocks(df, lists), path)
    blocks, again = knn.load_lists(spark, path)
    assert again.probes == lists.probes and (again.centroids == lists.centroids).all()
    assert sum(len(b.ids) for b in blocks.collect()) == 1000
    q = df.where("chunk_id < 'c0050'").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert min(recall(q, df, knn.probe_top_k(q, blocks, again, 10))) >= 0.9


def test_lists_of_edge_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], "chunk_id string, song_id string, embedding array<float>")
    assert knn.approximate_top_k(empty.withColumnRenamed("chunk_id", "query_id"), empty, 3).count() == 0
    rows = [("a", "s", [1.0, 0.0]), ("b", "s", [1.0, 0.0]), ("c", None, None), ("d", "t", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, song_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.chunk_id for r in knn.approximate_top_k(q, df, 2).orderBy("rank").collect()] == ["a", "b"]
    monkeypatch.setattr(knn, "BROADCAST_BLOCKS", 0)
    assert [r.chunk_id for r in knn.approximate_top_k(q, df, 2).orderBy("rank").collect()] == ["a", "b"]


def test_best_groups_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "ITEM_BLOCK", 7)
    v, df = vectors(spark)
    q = df.where("chunk_id < 'c010'").select(F.col("chunk_id").alias("query_id"), "embedding")
    s, songs = np.round(v.astype(float) @ v.astype(float).T, 6), [r.song_id for r in df.orderBy("chunk_id").collect()]
    for r in knn.exact_top_groups(q, df, 3, "song_id").collect():
        best = {g: max(s[int(r.query_id[1:]), j] for j in range(len(songs)) if songs[j] == g) for g in set(songs)}
        assert sorted(best.items(), key=lambda x: (-x[1], x[0]))[r["rank"] - 1] == (r.song_id, r.score)


def test_dense_search_statuses(spark):
    _, df = vectors(spark)
    q = spark.createDataFrame([("ok", [1.0] * 16), ("zero", [0.0] * 16), ("none", None)], "query_id string, embedding array<float>")
    hits, status = retrieval.dense_search(q, df, 20)
    assert {r.query_id: r.status for r in status.collect()} == {"ok": "ok", "zero": "query_out_of_vocabulary", "none": "empty_query"}
    assert {r.query_id for r in hits.collect()} == {"ok"} and hits.count() <= 7


def test_vector_reports(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [0.6, 0.8])], "i string, embedding array<float>")
    r = emb.embedding_report(df).first()
    assert (r.n_vectors, r.dim, r.norm_min, r.norm_max, r.n_unit, r.n_no_signal) == (3, 2, 0.0, 5.0, 1, 1)
    assert emb.half_precision(df, "i").where("i = 'c'").first().embedding[0] == pytest.approx(0.6, abs=1e-3)
    with pytest.raises(RuntimeError, match="sentence-transformers"):
        emb.neural_vectors(df.withColumn("t", F.lit("x")), "i", "t", "some-model")


RANKED = [(["a", "b", "c"], ["b"]), (["a"], []), ([], ["a"]), (["x", "y", "a", "b"], ["a", "b", "a"]), (["a", "b"], ["a", "b", "c", "d"])]


def plain_metrics(ranked, relevant):
    rel = set(relevant)
    recall = lambda k: len(rel & set(ranked[:k])) / len(rel) if rel and ranked else 0.0
    rr = next((1 / i for i, x in enumerate(ranked, 1) if x in rel), 0.0)
    dcg = sum(1 / math.log2(i + 1) for i, x in enumerate(ranked[:10], 1) if x in rel)
    best = sum(1 / math.log2(i + 1) for i in range(1, min(len(rel), 10) + 1))
    return [recall(1), recall(5), recall(10), rr, dcg / best if best else 0.0]


def test_metrics(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(RANKED)], "query_id int, ranked array<string>, relevant_song_ids array<string>")
    rows = evaluation.query_metrics(df).orderBy("query_id").collect()
    for r, (a, b) in zip(rows, RANKED):
        assert [r[x] for x in m.METRICS] == pytest.approx(plain_metrics(a, b))
    with pytest.raises(ValueError):
        m.recall_at_k(F.col("ranked"), F.col("relevant_song_ids"), -1)


def test_bootstrap():
    values = np.array([0, 1, 1, 0, 0.5, 0.25])
    mean, low, high = m.bootstrap_mean(values, n_boot=2000)
    rng = np.random.default_rng(0)
    means = values[rng.integers(0, 6, size=(2000, 6))].mean(axis=1)
    assert (mean, low, high) == (values.mean(), *np.quantile(means, [0.025, 0.975]))
    assert m.bootstrap_mean(np.array([0.3])) == (0.3, 0.3, 0.3)
    for bad in ({"confidence": 0}, {"confidence": 1}):
        with pytest.raises(ValueError):
            m.bootstrap_mean(values, **bad)
    with pytest.raises(ValueError):
        m.bootstrap_mean(np.array([]))


def test_intervals_of_all_arms(spark, tables):
    arms = {r.arm for r in queries.arm_comparison(spark, tables).collect()}
    rows = queries.eval_intervals(spark, tables).collect()
    slices = queries.eval_slices(spark, tables).collect()
    assert len(arms) == 6 and {r.arm for r in rows} == arms
    key = lambda r: (r.arm, r.dimension, r.value, r.metric, r.n)
    assert sorted(map(key, rows)) == sorted(map(key, slices))
    values = {}
    for r in queries.query_metrics(spark, tables).orderBy("query_id").collect():
        values.setdefault(r.arm, []).append(r.MRR)
    for r in rows:
        if (r.dimension, r.metric) == ("overall", "MRR"):
            # the draws of values and of their counts have one distribution
            mean, low, high = m.bootstrap_mean(np.array(values[r.arm]))
            assert r.mean == pytest.approx(mean, abs=1e-5) and (r.ci_lo, r.ci_hi) == pytest.approx((low, high), abs=0.1 * (high - low))


def test_intervals_are_one_method_at_every_size(spark):
    rng = np.random.default_rng(1)
    rows = [("few", float(x)) for x in (0, 1, 1, 0.5)] + [("one", 0.3), ("same", 0.5), ("same", 0.5), ("none", None)]
    rows += [("many", float(x)) for x in rng.choice([0, 0.2, 1], 3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in m.mean_ci(df, ["g"], "x").collect()}
    assert set(got) == {"few", "one", "same", "many"} and (got["one"].ci_lo, got["one"].ci_hi) == (0.3, 0.3) and got["same"].ci_hi == 0.5
    for g in ("few", "many"):
        mean, low, high = m.bootstrap_mean(np.array([x for k, x in rows if k == g]))
        assert got[g].mean == pytest.approx(mean) and (got[g].ci_lo, got[g].ci_hi) == pytest.approx((low, high), abs=0.05 * (high - low))
    wide, narrow = (m.mean_ci(df.where("g = 'many'"), ["g"], "x", confidence=c).first() for c in (0.99, 0.5))
    assert wide.ci_lo < got["many"].ci_lo < narrow.ci_lo < narrow.ci_hi < got["many"].ci_hi < wide.ci_hi
    with pytest.raises(ValueError):
        m.mean_ci(df, ["g"], "x", confidence=1.0)


def test_labels_and_slices(spark):
    songs = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "song_id string")
    chunks = spark.createDataFrame([("s1", "none", True), ("s1", "none", None), ("s2", "none", False), ("s2", "blank_line", False)], "song_id string, split_by string, force_split boolean")
    labels = evaluation.song_split_labels(songs, chunks)
    assert {r.song_id: r.split_label for r in labels.collect()} == {"s1": "none/force_split=True", "s2": "mixed/force_split=False", "s3": "(unknown)"}
    q = spark.createDataFrame([(1, ["s1"]), (2, ["s1", "s2"]), (3, []), (4, ["gone"])], "query_id int, relevant_song_ids array<string>")
    assert {r.query_id: r.value for r in evaluation.query_labels(q, labels, "split_label").collect()} == {1: "none/force_split=True", 2: "mixed", 3: "(unknown)", 4: "(unknown)"}


def test_stratum_selection(spark):
    q = spark.createDataFrame([(1, "main"), (2, None)], "query_id int, stratum string")
    assert evaluation.select_stratum(q, "main").count() == 1
    with pytest.raises(ValueError, match="no query of stratum"):
        evaluation.select_stratum(q, "other")
    with pytest.raises(ValueError, match="no strata"):
        evaluation.select_stratum(q.where("query_id = 2"), "main")


def test_overlap(spark):
    idf = spark.createDataFrame([("the", 1.0), ("cat", 2.0), ("gem", 5.0)], "term string, idf double")
    pairs = spark.createDataFrame([(1, "the gem zzz gem", "the gem"), (2, "zzz", "zzz"), (3, "", "the"), (4, "the", None)], "k int, q string, s string")
    rows = {r.k: r for r in leak.weighted_overlap(pairs, ["k"], tx.tfidf_terms(F.col("q")), tx.tfidf_terms(F.col("s")), idf).collect()}
    assert (rows[1].ratio, rows[1].max_shared_idf, rows[1].shared, rows[1].unknown) == (1.0, 5.0, ["gem", "the"], ["zzz"])
    assert (rows[2].ratio, rows[2].unknown) == (0.0, ["zzz"]) and rows[3].weight_total == 0 and rows[4].ratio == 0


def test_attrition(spark):
    rows = [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False), (2, 3, False), (3, 1, None)]
    df = spark.createDataFrame(rows, "k int, attempt int, passes boolean")
    assert {r.k: (r.first_pass, r.n_attempts, r.state) for r in leak.attrition(df, ["k"]).collect()} == {1: (2, 2, "passed"), 2: (None, 3, "exhausted"), 3: (None, 1, "pending")}


def test_strata_are_disjoint_and_exact(spark):
    a = spark.createDataFrame([(f"s{i}",) for i in range(20)], "song_id string")
    b = spark.createDataFrame([(f"s{i}",) for i in range(40)], "song_id string")
    got = pooling.stratified_sample([("rare", a, 15), ("main", b, 25)], "song_id", 1).collect()
    assert len({r.song_id for r in got}) == 40
    with pytest.raises(ValueError, match="has 25 of 26"):
        pooling.stratified_sample([("rare", a, 15), ("main", b, 26)], "song_id", 1)


def test_themes(spark):
    rows = [(1, None, None, None, None, None), (2, False, "no", 1, None, None), (3, True, "yes", 2, None, None), (4, None, "unsure", 3, None, None)]
    t = spark.createDataFrame(rows, "theme_id int, keep boolean, mark string, mark_seq bigint, recheck boolean, mark_before_recheck string")
    assert {r.theme_id for r in pooling.usable_themes(t).collect()} == {1, 3}
    once = pooling.stamp_recheck(t)
    assert [(r.theme_id, r.mark_before_recheck) for r in once.where("recheck").collect()] == [(4, "unsure")]
    again = pooling.stamp_recheck(once.withColumn("mark", F.when(F.col("theme_id") == 3, "unsure").otherwise(F.col("mark"))))
    assert [r.theme_id for r in again.where("recheck").collect()] == [4]  # a queue is open
    assert {r.theme_id for r in pooling.select_themes(once, "flagged").collect()} == {4}
    with pytest.raises(ValueError):
        pooling.select_themes(t, "some")
    assert pooling.undo_last(t).where("mark is not null").count() == 2


def test_judges_see_no_arms(spark):
    p = pooling.pool(spark.createDataFrame([(1, "s", "a", 1), (1, "s", "b", 4), (1, "t", "b", 9)], "query_id int, song_id string, arm string, rank int"))
    assert p.count() == 1 and p.first().n_arms == 2
    with pytest.raises(ValueError, match="found_by"):
        pooling.blinded(p, {"query_id", "song_id", "best_rank", "n_arms"})
    assert pooling.blinded(p.select("query_id", "song_id"), {"query_id", "song_id"}).count() == 1


def test_preprocess_routes_everything(spark):
    good = "[Verse]\n" + "some words of a real verse here\n" * 2 + "\n[Chorus]\n" + "la la la la la la la\n" + "\n[Chorus]\nLa la la, la la la la!\n\n[Outro]\nbye"
    rows = [("g", "A", "T", good), ("e", "A", "T", "  "), ("i", "A", "T", "[ Instrumental ]"), ("s", "A", "T", "three words only"), ("n", "A", "English Translations", None)]
    songs = spark.createDataFrame([(*r, "src", None) for r in rows], "song_id string, artist string, title string, text_raw string, source string, is_translation boolean")
    flagged, chunks, rejects = ingest.preprocess(songs)
    reasons = sorted((r.level, r.reason, r.song_id) for r in rejects.collect())
    assert reasons == [("chunk", "chunk_duplicate_block", "g"), ("chunk", "chunk_too_short", "g"), ("song", "song_empty_text", "e"), ("song", "song_empty_text", "n"), ("song", "song_instrumental_only", "i"), ("song", "song_too_short", "s")]
    assert sorted(r.position for r in chunks.collect()) == [0, 1]
    assert [r.song_id for r in flagged.where("is_translation").collect()] == ["n"]


def test_blank_blocks_are_duplicates_of_each_other(spark):
    c = spark.createDataFrame([("a:0", "a", 0, "!!"), ("a:1", "a", 1, None), ("a:2", "a", 2, "…")], "chunk_id string, song_id string, position int, text string")
    got = {r.chunk_id: r.reject_reason for r in ingest.judge_chunks(c).collect()}
    assert got == {"a:0": "chunk_too_short", "a:1": "chunk_duplicate_block", "a:2": "chunk_duplicate_block"}


def test_only_hot_keys_are_salted(spark):
    big = materialize(spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(200)] + [(None, -1)], "k string, i int"))
    one = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3)], "k string, v int")
    assert [r.k for r in hot_keys(big, ["k"], rows=50).collect()] == ["hot"] and hot_keys(big, ["k"], rows=100).count() == 0
    for how in ("inner", "left"):
        want = sorted(big.join(one, "k", how).collect(), key=str)
        assert sorted(skewed_join(big, one, ["k"], F.col("i"), how, rows=50).collect(), key=str) == want
        assert sorted(counted_join(big, one, ["k"], F.col("i"), how, most=1).collect(), key=str) == want
        assert sorted(counted_join(big, one, ["k"], F.col("i"), how).collect(), key=str) == want


def test_discarded_tables_are_gone(spark):
    t = materialize(spark.range(5))
    discard(t)
    with pytest.raises(Exception):
        t.count()


REPLIES = "chunk_id string, attempt int, paraphrase string, description string"
FRAGMENTS = "chunk_id string, song_id string, stratum string, text string"


def gated(spark, replies, n_docs=1000):
    fragments = spark.createDataFrame([("c1", "s1", "main", "the rare harbor"), ("c2", "s2", "main", "a common tune"), ("c3", "s3", "other", None)], FRAGMENTS)
    songs = spark.createDataFrame([("s1", "Lantern", "Ann"), ("s2", None, None), ("s3", "x", "y")], "song_id string, title string, artist string")
    idf = spark.createDataFrame([("rare", 6.0), ("harbor", 5.9), ("common", 1.2), ("lantern", 6.1), ("the", 1.0)], "term string, idf double")
    return fragments, gate.score_attempts(gate.long_replies(spark.createDataFrame(replies, REPLIES)), fragments, songs, idf, n_docs)


def test_gate(spark):
    """n = 1000 and at most 100 chunks a term: the gate's idf is ln(1001 / 101) + 1 = 3.29."""
    replies = [("c1", None, "a rare thing", "the sea"), ("c1", 2, "a lantern", None), ("c2", 1, "common rare", "common"), ("c2", 2, None, "late"), ("c3", 3, "nothing", None), ("c1", 3, "rare again", "common")]
    fragments, scored = gated(spark, replies)
    rows = {(r.chunk_id, r.query_type, r.attempt): r for r in scored.collect()}
    assert len(rows) == 9 and {k for k, r in rows.items() if not r.passes} == {("c1", "paraphrase", 1), ("c1", "paraphrase", 3)}
    assert rows["c1", "paraphrase", 1].shared == ["rare"] and rows["c1", "paraphrase", 1].max_shared_df == pytest.approx(1001 / math.exp(5) - 1)
    assert rows["c1", "description", 1].ratio == 1 and rows["c2", "description", 2].ratio == 0 and rows["c2", "description", 2].max_shared_df is None
    assert {k for k, r in rows.items() if r.title_leak} == {("c1", "paraphrase", 2)}
    ok = {(r.chunk_id, r.query_type): (r.query, r.attempt, r.relevant_song_ids) for r in gate.accepted(scored).collect()}
    assert ok["c1", "paraphrase"] == ("a lantern", 2, ["s1"]) and ok["c2", "description"] == ("common", 1, ["s2"]) and len(ok) == 5
    assert gate.retries(scored).count() == 0
    report = {(r.query_type, r.stratum): r for r in gate.attrition_report(scored).collect()}
    assert report["paraphrase", "main"].n_retried == 1 and report["paraphrase", "main"].repeat_fail_rate == 0
    with pytest.raises(ValueError, match="1 fragments have no reply"):
        gate.assemble(scored.where("chunk_id <> 'c3'"), fragments)
    chosen, again, meta = gate.assemble(scored.where("chunk_id <> 'c3'"), fragments, partial=True)
    assert meta["partial"] and (meta["queries"], meta["songs"]) == (4, 2) == (chosen.count(), chosen.select("chunk_id").distinct().count()) and again.count() == 0


def test_gate_retries_and_losses(spark):
    fragments, scored = gated(spark, [("c1", 1, "rare", "harbor"), ("c1", 2, "rare", None), ("c1", 3, "harbor rare", None)])
    totals = gate.attrition_totals(scored).first()
    assert (totals.n_accepted, totals.n_lost_paraphrase, totals.n_retry) == (0, 1, 1)
    assert [r.chunk_id for r in gate.retries(scored).collect()] == ["c1"]
    report = {r.query_type: r for r in gate.attrition_report(scored).collect()}
    assert report["paraphrase"].repeat_fail_rate == 1 and report["description"].repeat_fail_rate is None
    assert gated(spark, [])[1].count() == 0


def test_arm_reports_are_paired(spark):
    fragments = spark.createDataFrame([("c1", "s1", "m", "rare harbor"), ("c2", "s2", "m", "common tune"), ("c3", "s3", "m", "lone")], FRAGMENTS)
    idf = spark.createDataFrame([("rare", 6.0), ("harbor", 5.9), ("common", 1.2), ("tune", 5.0)], "term string, idf double")
    rows = [("a", "c1", 1, "rare tune", "x"), ("a", "c2", 1, "harbor", "tune"), ("b", "c1", 1, "calm", "calm"), ("b", "c2", 1, "sea", "sky"), ("b", "c3", 1, "lone", None)]
    replies = spark.createDataFrame(rows, "arm string, " + REPLIES)
    scored = materialize(gate.arm_rows(replies, fragments, idf, 1000))
    got = {(r.arm, r.chunk_id, r.query_type): r for r in scored.collect()}
    assert len(got) == 8 and not any(k[1] == "c3" for k in got)  # only what all arms have
    r = got["a", "c1", "paraphrase"]
    assert (r.own_max_idf, r.cross_max_idf, r.cross_terms, r.other_fragment, r.passes, r.cross_over) == (6.0, 5.0, ["tune"], "c2", False, True)
    reports = gate.arm_reports(scored)
    assert {(x.arm, x.query_type): x.n_over for x in reports["cross"].collect()} == {("a", "paraphrase"): 2, ("a", "description"): 0, ("b", "paraphrase"): 0, ("b", "description"): 0}
    assert {x.arm: x.pair_jaccard for x in reports["lengths"].collect()} == {"a": 0.0, "b": 0.5}
    assert {(x.arm, x.place): x.n for x in reports["places"].collect()} == {(a, p): 2 for a in "ab" for p in (0, 1)}


def test_duplicate_samples(spark):
    df = spark.createDataFrame([("x", f"i{i}") for i in range(5)] + [("y", "a"), ("y", "b"), ("z", "c"), (None, "d"), (None, "e")], "k string, id string")
    got = {r.k: (r.n_rows, r.ids) for r in ingest.duplicate_samples(df, F.col("k"), "id").collect()}
    assert got == {"x": (5, ["i0", "i1", "i2"]), "y": (2, ["a", "b"])}
    same = ingest.duplicate_summary(df, {"one": F.col("k"), "two": F.upper("k")})
    ingest.require_same_groups(same, "one", "two")
    with pytest.raises(ValueError, match="disagree"):
        ingest.require_same_groups(ingest.duplicate_summary(df, {"one": F.col("k"), "two": F.col("id")}), "one", "two")
