import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedders as emb
from quillspark.operators import retrieval
from quillspark.plans import build, cache, cli
from quillspark.plans.config import Experiment, load_config
from quillspark.plans.registry import EMBEDDERS, INDEXES
from quillspark.sources import records
from quillspark.sources import songs as src
from quillspark.streaming import ingest as stream


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("embedder: tfidf\nretrieval: {mode: hybrid}\n")
    c = load_config(p)
    assert c == Experiment("dev", "sections", "tfidf", {}, "numpy", "hybrid", 60, 50, 10)
    p.write_text("embedder: {name: fasttext-avg, params: {vectors_path: x}}\nindex: faiss\nchunking: whole_song\n")
    c = load_config(p)
    assert (c.embedder, c.params, c.index, c.chunking, c.mode) == ("fasttext-avg", {"vectors_path": "x"}, "faiss", "whole_song", "dense")
    p.write_text("")
    assert load_config(p).embedder == "bge-m3"
    for bad in ("colour: red", "embedder: nobody", "index: nothing", "corpus: huge", "embedder: fasttext-avg", "retrieval: {mode: psychic}", "retrieval: {top_k: many}", "retrieval: {depth: 3}", "embedder: {name: tfidf, params: 3}", "[1]", "retrieval: 3"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            load_config(p)


def test_registry():
    assert EMBEDDERS.names() == sorted(EMBEDDERS.names()) and EMBEDDERS.required("fasttext-avg") == ("vectors_path",)
    with pytest.raises(KeyError, match="tfidf"):
        EMBEDDERS.resolve("nobody")
    with pytest.raises(TypeError):
        INDEXES.resolve("faiss").check(sparse=True)
    with pytest.raises(RuntimeError, match="not fitted"):
        EMBEDDERS.resolve("tfidf").encode(None)


def test_cache(spark, tmp_path):
    a, b = cache.cache_key({"x": 1, "y": 2}, "in"), cache.cache_key({"y": 2, "x": 1}, "in")
    assert a == b != cache.cache_key({"x": 1, "y": 2}, "other")
    assert cache.canonical_json({"b": "é", "a": [1]}) == '{"a":[1],"b":"\\u00e9"}'
    stages = cache.Stages(spark, tmp_path)
    made = []

    def write(path):
        made.append(path)
        spark.range(3).write.parquet(path)
        return {"n": 3}

    with pytest.raises(FileNotFoundError, match="one.*not been built"):
        stages.path("one")
    key = stages.build("one", {"x": 1}, "in", write)
    assert stages.build("one", {"x": 1}, "in", write) == key and len(made) == 1 and stages.is_fresh("one", key)
    assert stages.manifest("one")["counted"] == {"n": 3} and stages.read("one").count() == 3
    assert stages.build("one", {"x": 2}, "in", write) != key and len(made) == 2
    assert stages.read("one").count() == 3 and len(list((tmp_path / "one").glob("v-*"))) == 1  # the older version is gone
    stages.build("one", {"x": 2}, "in", write, force=True)
    assert len(made) == 3

    def dies(path):
        spark.range(1).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stages.build("one", {"x": 3}, "in", dies)
    assert stages.read("one").count() == 3  # readers keep the whole version
    stages.replace_text("{broken", "one", "manifest.json")
    assert stages.manifest("one") is None and stages.read_text("gone") is None


def test_rows_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert cache.rows_hash(a) == cache.rows_hash(a.orderBy(F.desc("i")).repartition(3)) != cache.rows_hash(a.where("i = 1"))
    assert cache.rows_hash(a) != cache.rows_hash(a.withColumnRenamed("s", "t"))


DEMO = Experiment.of({"corpus": "demo", "embedder": "tfidf", "retrieval": {"mode": "hybrid"}})


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("built")
    return root, DEMO, build.run_build(spark, DEMO, root, src.demo_songs())


def test_build_is_cached_stage_by_stage(spark, built):
    root, config, keys = built
    before = {p: p.stat().st_mtime_ns for p in root.rglob("manifest.json")}
    assert len(before) == 5
    assert build.run_build(spark, config, root, src.demo_songs()) == keys
    assert {p: p.stat().st_mtime_ns for p in root.rglob("manifest.json")} == before
    with pytest.raises(ValueError, match="build again"):
        build.check_keys(build.Corpus(spark, replace(config, params={"max_features": 50}), root))


def test_demo_corpus(spark, built):
    corpus = build.Corpus(spark, built[1], built[0])
    chunks = corpus.chunks()
    assert chunks.count() == 500 and chunks.where("force_split or split_by <> 'bracket_tag'").count() == 0
    counted = corpus.stages.manifest(corpus.chunk_stage)["counted"]
    assert counted == {"n_chunks": 500, "rejects": {}} and corpus.rejects().count() == 0
    counted = corpus.stages.manifest(corpus.vector_stage)["counted"]
    assert counted["sparse"] and counted["n_vectors"] == 500 and counted["n_rejected"] == 0


def test_search_finds_its_theme(spark, built):
    root, config, _ = built
    q = spark.createDataFrame([(1, "the quiet harbor"), (2, " ")], "query_id bigint, query string")
    songs = build.Corpus(spark, config, root).songs()
    for mode in ("dense", "lexical", "hybrid"):
        hits, status = build.run_search(spark, replace(config, mode=mode), q, root)
        first = hits.where("rank = 1").join(songs, "song_id").first()
        assert first.title.startswith("Harbor")
        assert {r.query_id: r.status for r in status.collect()} == {1: "ok", 2: "empty_query"}


def test_written_indexes_give_what_fitting_gives(spark, built):
    root, config, _ = built
    corpus = build.Corpus(spark, config, root)
    q = spark.createDataFrame([(1, "the quiet harbor"), (2, "orchard by the river"), (3, "zzz")], "query_id bigint, query string")
    key = lambda rows: sorted((r.query_id, r["rank"], r.song_id, round(r.score, 6), r.best_chunk_id) for r in rows.collect())
    assert key(build.run_search(spark, replace(config, mode="lexical"), q, root)[0]) == key(retrieval.lexical_search(q, corpus.songs(), corpus.chunks())[0])
    assert key(build.run_search(spark, replace(config, mode="dense"), q, root)[0]) == key(retrieval.dense_sparse_search(q, corpus.chunks())[0])


def test_fitted_state_is_checked(spark, tmp_path):
    build.run_build(spark, DEMO, tmp_path, src.demo_songs())
    corpus = build.Corpus(spark, DEMO, tmp_path)
    corpus.embedder()
    spark.createDataFrame([("a", 1, 1.0)], corpus.embedder().model.idf.schema).write.mode("append").parquet(corpus.stages.path(corpus.vector_stage, "fitted", "idf"))
    with pytest.raises(ValueError, match="build again"):
        corpus.embedder()


def test_approximate_index_of_a_build(spark, tmp_path, monkeypatch):
    """Dense vectors of words, searched through written lists, against all vectors."""
    words = "harbor orchard railway lantern winter desert river attic market thunder garden island mirror engine meadow canyon pillow compass saddle ribbon".split()
    vec = write(tmp_path / "w.vec", [f"{len(words)} 20", *(f"{w} " + " ".join("1.0" if i == j else "0.1" for j in range(20)) for i, w in enumerate(words))])
    where = records.convert_word_vectors(spark, vec, str(tmp_path / "w"), len(words))
    given = {"corpus": "demo", "embedder": {"name": "fasttext-avg", "params": {"vectors_path": where, "limit": len(words)}}, "index": "faiss"}
    approximate = Experiment.of(given)
    exact = replace(approximate, index="numpy")
    q = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "query_id bigint, query string")
    found = {}
    for config in (approximate, exact):
        build.run_build(spark, config, tmp_path / "data", src.demo_songs())
        hits = build.run_search(spark, config, q, tmp_path / "data")[0].where("rank <= 5")
        found[config.index] = {(r.query_id, r.song_id) for r in hits.collect()}
    assert len(found["faiss"] & found["numpy"]) >= 0.9 * len(found["numpy"]) > 0
    corpus = build.Corpus(spark, approximate, tmp_path / "data")
    assert corpus.stages.has(corpus.index_stage, "lists", "blocks") and not corpus.stages.has(corpus.index_stage, "vectors")
    with pytest.raises(TypeError, match="dense vectors only"):
        build.run_build(spark, replace(DEMO, index="faiss"), tmp_path / "data", src.demo_songs())


def test_eval_of_a_build(spark, built):
    root, config, _ = built
    q = spark.createDataFrame([(1, "the harbor", ["demo0000"], None, "main"), (2, "the orchard", ["demo0100"], None, "main")], "query_id bigint, query string, relevant_song_ids array<string>, query_type string, stratum string")
    songs = build.Corpus(spark, config, root).songs()
    records.write_genre_lookup(songs.select("song_id", F.lit("pop").alias("genre"), F.lit(1).alias("id")), songs, str(root), "demo")
    genre = records.genre_lookup(spark, str(root), "demo")
    table = build.run_eval(spark, config, q, root, genre=genre, intervals=False).collect()
    assert {r.dimension for r in table} == {"overall", "split_by", "is_translation", "stratum", "genre"} and all(0 <= r["mean"] <= 1 for r in table)
    assert {r.value for r in table if r.dimension == "genre"} == {"pop"}
    with pytest.raises(FileNotFoundError, match="write_genre_lookup"):
        records.genre_lookup(spark, str(root), "dev")


def test_matrix_of_arms(spark, built):
    root, config, _ = built
    q = spark.createDataFrame([(1, "the harbor", ["demo0000"]), (2, " ", ["demo0100"])], "query_id bigint, query string, relevant_song_ids array<string>")
    arms = {m: replace(config, mode=m) for m in ("dense", "lexical", "hybrid")}
    metrics, status, pool, seconds = build.run_matrix(spark, arms, q, root)
    assert {r.arm: r.n for r in metrics.collect()} == dict.fromkeys(arms, 2) and set(seconds) == set(arms)
    assert {(r.arm, r.status): r.n for r in status.collect()} == {(a, s): 1 for a in arms for s in ("ok", "empty_query")}
    pooled = pool.collect()
    assert len(pooled) >= 5 and all(r.query_id == 1 and r.n_arms == len(r.found_by) for r in pooled)


def test_command_line(spark, tmp_path, capsys):
    c = tmp_path / "c.yaml"
    c.write_text("corpus: demo\nembedder: tfidf\n")
    root = ["--config", str(c), "--data-root", str(tmp_path / "d")]
    cli.main(["ingest", *root, "--demo"])
    assert capsys.readouterr().out.count(":") == 1
    cli.main(["build", *root, "--demo"])
    cli.main(["search", *root, "the harbor", "--repeat", "2"])
    out = capsys.readouterr().out
    assert "Harbor" in out and "repeat_search" in out and "ms" in out


def test_meta_files(spark, tmp_path):
    path = str(tmp_path / "pool")
    df = spark.createDataFrame([(i, None if i % 2 else f"s{i}") for i in range(20)], "query_id int, song_id string")
    records.write_with_meta(df, path, {"depth": 5}, ["query_id"])
    meta, again = records.read_with_meta(spark, path, df.schema)
    assert meta == {"depth": 5} and sorted(again.collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        records.write_with_meta(df, path, {}, ["query_id"])
    records.replace_with_meta(again.where("query_id < 5"), path, {"depth": 6}, ["query_id"])
    meta, again = records.read_with_meta(spark, path, df.schema)
    assert meta == {"depth": 6} and again.count() == 5


def test_line_numbers_and_faults(spark, tmp_path):
    lines = [{"artist": "A", "title": "T"}] * 3 + [{"artist": "A"}, "", "{no"] + [{"artist": "A", "title": "T"}] * 50
    p = write(tmp_path / "x.jsonl", lines)
    got = records.file_lines(spark, p).collect()
    assert sorted(r.line for r in got) == list(range(1, 57))
    assert [(r.line, r.problem) for r in src.JsonlSongs(p).faults(spark).orderBy("line").collect()] == [(4, "title is missing"), (6, "not a JSON record")]


def test_token_lengths(spark):
    file = "/opt/tokenizers/word_bpe_49k.json"
    pytest.importorskip("tokenizers")
    if not Path(file).exists():
        pytest.skip("no tokenizer file")
    df = spark.createDataFrame([(1, "la"), (2, "la la la la"), (3, None)], "id int, text string")
    got = {r.id: r.n_tokens for r in emb.token_lengths(df, "id", "text", file).collect()}
    assert got[1] < got[2] and got[3] <= got[1]
    longer = {r.id: r.n_tokens for r in emb.token_lengths(df, "id", "text", file, prefix=True).collect()}
    assert all(longer[i] > got[i] for i in (1, 2))
    assert [r.id for r in emb.overflow_sample(df, "id", F.length("text"), 1, 1).collect()] == [1]


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_songs(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", [{"artist": "A", "title": "T", "lyrics": "la"}, "", {"artist": "B", "title": "U", "song_id": "", "text_raw": "x", "is_translation": True, "source": "me"}])
    rows = {r.artist: r for r in src.JsonlSongs(p)(spark).collect()}
    assert rows["A"].text_raw == "la" and rows["A"].source == "jsonl:a.jsonl" and not rows["A"].is_translation and len(rows["A"].song_id) == 16
    assert rows["B"].source == "me" and rows["B"].is_translation and len(rows["B"].song_id) == 16
    for bad, said in (([{"artist": "A"}], "title is missing"), (["{no"], "not a JSON record")):
        with pytest.raises(Exception, match=said):
            src.JsonlSongs(write(tmp_path / "b.jsonl", bad))(spark).collect()


def test_parquet_songs(spark, tmp_path):
    p = str(tmp_path / "p")
    spark.createDataFrame([(i, f"a{i}", "t", None) for i in range(10)], "id int, artist string, title string, lyrics string").write.parquet(p)
    a = [r.artist for r in src.ParquetSongs(p, sample_size=4)(spark).collect()]
    assert len(a) == 4 and a == [r.artist for r in src.ParquetSongs(p, sample_size=4)(spark).collect()] == sorted(a)
    with pytest.raises(NotImplementedError):
        src.ScraperSongs("x")(spark)


GOOD = {"query": "q", "relevant_song_ids": ["s1", "s2", "s1"]}


def test_eval_set(spark, tmp_path):
    known = spark.createDataFrame([("s1",), ("s2",)], "song_id string")
    p = write(tmp_path / "e.jsonl", [{"_meta": {"v": 1}}, GOOD, "", {**GOOD, "stratum": "main", "query_type": "x"}])
    rows = records.eval_set(spark, p, known).orderBy("query_id").collect()
    assert [r.relevant_song_ids for r in rows] == [["s1", "s2"]] * 2 and rows[1].stratum == "main"
    bad = [({**GOOD, "more": 1}, "unknown field more"), ({"query": " ", "relevant_song_ids": ["s1"]}, "query is missing"), ({"query": "q", "relevant_song_ids": []}, "relevant_song_ids"), ({**GOOD, "stratum": "odd"}, "unknown stratum"), ({"query": "q", "relevant_song_ids": ["zz"]}, "no such song: zz"), ("{no", "not a JSON"), ("[1]", "not a JSON")]
    for record, said in bad:
        with pytest.raises(ValueError, match=said) as e:
            records.eval_set(spark, write(tmp_path / "f.jsonl", [GOOD, record]), known)
        assert "f.jsonl:2" in str(e.value)
    with pytest.raises(ValueError, match="no queries"):
        records.eval_set(spark, write(tmp_path / "g.jsonl", [{"_meta": {}}]), known)


def test_small_files(spark, tmp_path):
    q = records.query_list(spark, write(tmp_path / "q.txt", ["# note", "", " rain ", "sun"]))
    assert [r.query for r in q.orderBy("query_id").collect()] == ["rain", "sun"]
    with pytest.raises(ValueError):
        records.query_list(spark, write(tmp_path / "n.txt", ["# only"]))
    write(tmp_path / "r1.jsonl", [{"chunk_id": "c", "paraphrase": "first"}, {"chunk_id": "c", "attempt": 2, "paraphrase": "two"}])
    write(tmp_path / "r2.jsonl", [{"chunk_id": "c", "paraphrase": "late"}])
    got = {(r.chunk_id, r.attempt): r.paraphrase for r in records.replies(spark, str(tmp_path / "r*.jsonl")).collect()}
    assert got == {("c", 1): "first", ("c", 2): "two"}
    t = [{"theme_id": "a", "text": "x", "tier": "short"}, {"theme_id": "b", "text": "x", "tier": "short", "keep": False}, {"theme_id": "c", "text": "x", "tier": "medium", "mark": "yes", "keep": True}]
    assert [r.theme_id for r in records.themes(spark, write(tmp_path / "t.jsonl", [{"_meta": 1}, *t])).collect()] == ["a", "c"]
    with pytest.raises(Exception, match="tier is missing"):
        records.themes(spark, write(tmp_path / "u.jsonl", [{"theme_id": "a", "text": "x"}])).collect()
    probe = ["intro", "QUERY: rain", "   1. A - B", "      some", "      words", "  2. C - D", "QUERY: sun", "   1. E - F"]
    got = {(r.query, r.place): (r.hit, r.fragment) for r in records.probe_report(spark, write(tmp_path / "p.txt", probe)).collect()}
    assert got == {("rain", 1): ("A - B", "some words"), ("rain", 2): ("C - D", ""), ("sun", 1): ("E - F", "")}


def test_word_vectors(spark, tmp_path):
    v = write(tmp_path / "w.vec", ["3 2", "the 1.0 0.0", "cat 0.0 1.0", "dog 0.5 0.5"])
    where = records.convert_word_vectors(spark, v, str(tmp_path / "w"), 2)
    assert {r.word: r.vector for r in records.load_word_vectors(spark, where, 2).collect()} == {"the": [1, 0], "cat": [0, 1]}
    with pytest.raises(ValueError, match="holds 2 words"):
        records.load_word_vectors(spark, where, 3)
    with pytest.raises(Exception, match="(?i)exists"):
        records.convert_word_vectors(spark, v, str(tmp_path / "w"), 2)


def test_stream_equals_batch(spark, tmp_path):
    rows = src.demo_songs()(spark).withColumn("ingested_at", F.current_timestamp())
    rows.where("song_id < 'demo10'").write.parquet(str(tmp_path / "in"))
    rows.where("song_id >= 'demo09'").write.mode("append").parquet(str(tmp_path / "in"))  # ten songs twice
    stream.write_corpus(stream.read_songs(spark, str(tmp_path / "in"), 1), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/songs")).count() == 200
    assert spark.read.parquet(str(tmp_path / "out/chunks")).select("chunk_id").distinct().count() == 500
    counts = stream.section_counts(stream.read_songs(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 500 + 25


def test_stream_keeps_late_songs_and_no_song_twice(spark, tmp_path):
    """Three batches, the later ones a month behind or ahead of the first."""
    rows = src.demo_songs()(spark)
    for n, (first, last, day) in enumerate((("demo00", "demo10", "2026-03-10"), ("demo08", "demo15", "2026-02-01"), ("demo00", "demo99", "2026-04-20"))):
        part = rows.where(f"song_id >= '{first}' and song_id < '{last}'").withColumn("ingested_at", F.lit(day).cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.write_corpus(stream.read_songs(spark, str(tmp_path / "in"), 1), str(tmp_path / "out")).awaitTermination()
        assert len(list((tmp_path / "out/songs").glob("batch=*"))) == n + 1
    songs = spark.read.parquet(str(tmp_path / "out/songs"))
    assert songs.count() == songs.select("song_id").distinct().count() == rows.count()
    assert songs.where("batch = 1").count() > 0 and songs.where("batch = 2").count() > 0
    chunks = spark.read.parquet(str(tmp_path / "out/chunks"))
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 500
