"""The offline build, ingest to index, and the searches and evaluations over it.

The stages songs, preprocessed, lexical, vectors and index lie under
``<root>/<corpus>`` (see ``cache.Stages``); a stage is built again if its key
changed, which its own settings or any stage before it does.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.metrics import METRICS
from ..operators import embedders as emb
from ..operators import evaluation, fusion, ingest, knn, pooling, retrieval
from ..operators import postings as inv
from . import cache
from .config import Experiment
from .registry import EMBEDDERS, INDEXES

DEV_SONGS, DEV_SEED = 500, 42


class Corpus:
    """The stages of one configuration under a root."""

    def __init__(self, spark: SparkSession, config: Experiment, root: object) -> None:
        self.spark, self.config, self.stages = spark, config, cache.Stages(spark, root)
        work = f"{config.corpus}/{config.chunking}"
        self.songs_stage = f"{config.corpus}/songs"
        self.chunk_stage = f"{work}/preprocessed"
        self.lexical_stage = f"{work}/lexical"
        self.vector_stage = f"{work}/embeddings/{config.embedder}"
        self.index_stage = f"{work}/indexes/{config.embedder}/{config.index}"

    def songs(self) -> DataFrame:
        return self.stages.read(self.chunk_stage, "songs")

    def chunks(self) -> DataFrame:
        return self.stages.read(self.chunk_stage, "chunks")

    def rejects(self) -> DataFrame:
        return self.stages.read(self.chunk_stage, "rejects")

    def bm25(self) -> inv.Bm25:
        return inv.load_bm25(self.spark, self.stages.path(self.lexical_stage))

    def vectors(self) -> DataFrame:
        """(chunk_id, term, weight) or (chunk_id, embedding), whichever was built."""
        for form in ("sparse", "dense"):
            if self.stages.has(self.vector_stage, form):
                return self.stages.read(self.vector_stage, form)
        raise FileNotFoundError(f"neither sparse nor dense vectors in stage {self.vector_stage!r} under {self.stages.root}")

    def embedder(self):
        """The embedder as it was fitted, checked against what was counted when it was."""
        held = self.stages.manifest(self.vector_stage)
        if held is None:
            raise FileNotFoundError(f"stage {self.vector_stage!r} has not been built under {self.stages.root}")
        made = EMBEDDERS.resolve(self.config.embedder, self.config.params)
        if hasattr(made, "model"):
            made.model = emb.load_model(self.spark, self.stages.path(self.vector_stage, "fitted"))
            if cache.rows_hash(made.model.idf) != held["counted"]["fit_hash"]:
                raise ValueError(f"the fitted state of {self.vector_stage!r} is not the one its vectors were made with; build again")
        return made


def _embed_settings(config: Experiment) -> dict:
    return {"embedder": config.embedder, "params": config.params}


def build_songs(corpus: Corpus, source, force: bool = False) -> str:
    config = corpus.config

    def write(path: str) -> dict:
        rows = source(corpus.spark)
        if config.corpus == "dev":
            rows = ingest.seeded_sample(rows, "song_id", DEV_SONGS, DEV_SEED)
        order = [F.col(c) for c in rows.columns if c != "song_id"]
        ingest.first_per_key(rows, "song_id", order).write.parquet(path)
        return {"n_songs": corpus.spark.read.parquet(path).count()}

    sample = {"sample_size": DEV_SONGS, "seed": DEV_SEED} if config.corpus == "dev" else {}
    return corpus.stages.build(corpus.songs_stage, {"corpus": config.corpus} | sample, cache.ROOT_HASH, write, force)


def build_chunks(corpus: Corpus, upstream: str, force: bool = False) -> str:
    def write(path: str) -> dict:
        flagged, chunks, rejects = ingest.preprocess(corpus.stages.read(corpus.songs_stage), corpus.config.chunking)
        for name, df in (("songs", flagged), ("chunks", chunks), ("rejects", rejects)):
            df.write.parquet(f"{path}/{name}")
        written = corpus.spark.read.parquet(f"{path}/rejects").groupBy("reason").count().collect()  # a handful of reasons
        return {"n_chunks": corpus.spark.read.parquet(f"{path}/chunks").count(), "rejects": {r["reason"]: r["count"] for r in written}}

    settings = {"chunking": corpus.config.chunking, "min_song_words": ingest.MIN_SONG_WORDS, "min_chunk_chars": ingest.MIN_CHUNK_CHARS}
    return corpus.stages.build(corpus.chunk_stage, settings, upstream, write, force)


def build_lexical(corpus: Corpus, upstream: str, force: bool = False) -> str:
    """The BM25 index of whole songs, read by every lexical search."""

    def write(path: str) -> dict:
        inv.save_bm25(retrieval.fit_lexical(corpus.songs()), path)
        return {"n_terms": corpus.spark.read.parquet(f"{path}/idf").count()}

    return corpus.stages.build(corpus.lexical_stage, {"k1": inv.K1, "b": inv.B, "epsilon": inv.EPSILON}, upstream, write, force)


def build_vectors(corpus: Corpus, upstream: str, force: bool = False) -> str:
    config, spark = corpus.config, corpus.spark

    def write(path: str) -> dict:
        embedder = EMBEDDERS.resolve(config.embedder, config.params)
        chunks = corpus.chunks()
        embedder.fit(chunks)
        form = "sparse" if embedder.sparse else "dense"
        embedder.encode(chunks).write.parquet(f"{path}/{form}")
        rows = spark.read.parquet(f"{path}/{form}")
        counted = {"sparse": embedder.sparse, "n_chunks": chunks.count()}
        if getattr(embedder, "model", None) is not None:
            emb.save_model(embedder.model, f"{path}/fitted")
            counted["fit_hash"] = cache.rows_hash(spark.read.parquet(f"{path}/fitted/idf"))
        if embedder.sparse:
            n = rows.agg(F.count_distinct("chunk_id").alias("n"), F.count_distinct("term").alias("dim"), F.count(F.lit(1)).alias("nnz")).first()
            counted |= {"n_vectors": n.n, "dim": n.dim, "n_nonzero": n.nnz}
        else:
            r = emb.embedding_report(rows).first()
            counted |= {"n_vectors": r.n_vectors, "dim": r.dim, "norm_min": r.norm_min, "norm_max": r.norm_max, "n_unit": r.n_unit}
        lost = chunks.join(rows.select("chunk_id").distinct(), "chunk_id", "left_anti").select(
            F.lit("chunk").alias("level"), F.lit("chunk_no_signal").alias("reason"), "song_id", "position", tx.preview(F.col("text")).alias("text_preview"), "chunk_id", F.lit(config.embedder).alias("embedder_name")
        )
        lost.write.parquet(f"{path}/rejects")
        return counted | {"n_rejected": spark.read.parquet(f"{path}/rejects").count()}

    return corpus.stages.build(corpus.vector_stage, _embed_settings(config), upstream, write, force)


def build_index(corpus: Corpus, upstream: str, force: bool = False) -> str:
    made = INDEXES.resolve(corpus.config.index)

    def write(path: str) -> dict:
        rows = corpus.vectors()
        sparse = "term" in rows.columns
        made.check(sparse)
        if made.approximate:
            lists = knn.fit_lists(rows, target=made.target)
            knn.save_lists(corpus.spark, lists, knn.list_blocks(rows, lists), f"{path}/lists")
            return {"lists": len(lists.centroids), "probes": lists.probes}
        # sorted by what searches join on, so that row groups can be skipped
        by = "term" if sparse else "chunk_id"
        rows.repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{path}/vectors")
        return {}

    settings = {"index": corpus.config.index, "embedder": corpus.config.embedder, "target": getattr(made, "target", None)}
    return corpus.stages.build(corpus.index_stage, settings, upstream, write, force)


def run_build(spark: SparkSession, config: Experiment, root: object, source, force: bool = False) -> dict[str, str]:
    """Bring all stages up to date; the key of each."""
    corpus = Corpus(spark, config, root)
    keys = {"ingest": build_songs(corpus, source, force)}
    keys["preprocess"] = build_chunks(corpus, keys["ingest"], force)
    keys["lexical"] = build_lexical(corpus, keys["preprocess"], force)
    keys["embed"] = build_vectors(corpus, keys["preprocess"], force)
    keys["index"] = build_index(corpus, keys["embed"], force)
    return keys


def check_keys(corpus: Corpus) -> None:
    """Raise unless the vectors were made of the chunks that are there, and the index of these vectors."""
    chunks, vectors, index = (corpus.stages.manifest(s) for s in (corpus.chunk_stage, corpus.vector_stage, corpus.index_stage))
    if chunks is None or vectors is None or vectors["key"] != cache.cache_key(_embed_settings(corpus.config), chunks["key"]):
        raise ValueError(f"{corpus.vector_stage} does not belong to the present chunks; build again")
    if index is None or index["upstream"] != vectors["key"]:
        raise ValueError(f"{corpus.index_stage} does not belong to the present vectors; build again")


def _dense(corpus: Corpus, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    check_keys(corpus)
    how, chunks = corpus.config, corpus.chunks()
    embedder = corpus.embedder()
    counted = corpus.stages.manifest(corpus.vector_stage)["counted"]
    if embedder.sparse:
        asked = inv.tfidf_vectors(queries.where(~retrieval.is_blank(F.col("query"))), "query_id", tx.tfidf_terms(F.col("query")), embedder.model)
        vectors = inv.of_terms(corpus.stages.read(corpus.index_stage, "vectors"), inv.few_terms(asked))
        scored = inv.sparse_scores(asked, "query_id", vectors, "chunk_id").withColumn("score", F.round("score", retrieval.DECIMALS)).where("score > 0")
        best = fusion.top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], how.top_k)
        norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("query_norm"))
        return retrieval._songs_of(best, chunks), retrieval._statuses(queries, norms, retrieval.NO_SIGNAL)
    encoded = embedder.encode(queries, "query_id", "query", is_query=True)
    wide = encoded.where(F.size("embedding") != counted["dim"]).limit(1).collect()
    if wide:
        raise ValueError(f"queries have {len(wide[0].embedding)} dimensions, the index has {counted['dim']}")
    asked = queries.select("query_id").join(encoded, "query_id", "left")
    index = None
    if INDEXES.resolve(how.index).approximate:
        index = knn.load_lists(corpus.spark, corpus.stages.path(corpus.index_stage, "lists"))
        vectors = chunks.select("chunk_id", "song_id")
    else:
        vectors = corpus.stages.read(corpus.index_stage, "vectors").join(chunks.select("chunk_id", "song_id"), "chunk_id")
    return retrieval.dense_search(asked, vectors, how.top_k, index=index)


def run_search(spark: SparkSession, config: Experiment, queries: DataFrame, root: object) -> tuple[DataFrame, DataFrame]:
    """(hits, status) of a query table over a built corpus, untrimmed; from the written indexes alone."""
    corpus = Corpus(spark, config, root)
    lexical = (lambda: retrieval.lexical_search(queries, corpus.songs(), corpus.chunks(), config.top_k, index=corpus.bm25()))
    if config.mode == "lexical":
        return lexical()
    dense = _dense(corpus, queries)
    return dense if config.mode == "dense" else retrieval.hybrid(dense, lexical(), config.rrf_k)


def timed_search(spark: SparkSession, config: Experiment, queries: DataFrame, root: object, repeat: int = 2) -> tuple[DataFrame, list[dict[str, float]]]:
    """Hits as shown, and per run the seconds of planning (encoding and scoring what is written on the way) and of the last job."""
    seconds, shown = [], None
    for _ in range(max(1, repeat)):
        began = time.perf_counter()
        shown = retrieval.trim(run_search(spark, config, queries, root)[0], config.return_n)
        planned = time.perf_counter()
        shown.write.format("noop").mode("overwrite").save()
        ended = time.perf_counter()
        seconds.append({"encode": planned - began, "search": ended - planned, "total": ended - began})
    return shown, seconds


def latency_means(seconds: list[dict[str, float]]) -> dict[str, float]:
    """The first run's total, and the means of the repeated ones."""
    again = seconds[1:] or seconds
    return {"first": seconds[0]["total"]} | {f"repeat_{k}": sum(s[k] for s in again) / len(again) for k in ("encode", "search", "total")}


def warm_up(spark: SparkSession, config: Experiment, root: object) -> None:
    """One search of one word, so that workers and code are there when the first question comes."""
    run_search(spark, config, spark.createDataFrame([(0, "a")], "query_id bigint, query string"), root)[0].write.format("noop").mode("overwrite").save()


def run_eval(spark: SparkSession, config: Experiment, queries: DataFrame, root: object, *, genre: DataFrame | None = None, stratum: str | None = None, intervals: bool = True) -> DataFrame:
    """The metric table of a query set, sliced by the properties of its relevant songs.

    A genre slice needs a lookup table; query_type and stratum slices need any value.
    """
    corpus = Corpus(spark, config, root)
    songs, chunks = corpus.songs(), corpus.chunks()
    if stratum is not None:
        queries = evaluation.select_stratum(queries, stratum)
    hits = run_search(spark, config, queries.select("query_id", "query"), root)[0]
    metrics = evaluation.query_metrics(evaluation.outcomes(queries, hits))
    dims = {
        "split_by": evaluation.query_labels(queries, evaluation.song_split_labels(songs, chunks), "split_label"),
        "is_translation": evaluation.query_labels(queries, songs.withColumn("label", F.col("is_translation").cast("string")), "label"),
    }
    if genre is not None:
        dims["genre"] = evaluation.query_labels(queries, genre, genre.columns[1])
    for c in ("query_type", *(() if stratum is not None else ("stratum",))):
        if c in queries.columns and queries.where(F.col(c).isNotNull()).take(1):
            dims[c] = evaluation.column_label(queries, F.col(c))
    return evaluation.slice_table(metrics, dims, intervals=intervals)


def run_matrix(spark: SparkSession, arms: dict[str, Experiment], queries: DataFrame, root: object, pool_depth: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, float]]:
    """(metrics by arm, statuses by arm, pool, seconds) of several built configurations on one query set.

    The arms are a handful of configurations: one job each, their hits written
    side by side with the arm's name, and everything after that one job for all.
    """
    from ..runtime import materialize

    runs, states, seconds = [], [], {}
    for arm, config in arms.items():
        began = time.perf_counter()
        hits, status = run_search(spark, config, queries.select("query_id", "query"), root)
        runs.append(materialize(hits.select(F.lit(arm).alias("arm"), F.col("query_id").cast("bigint").alias("query_id"), "song_id", "rank"), "arm"))
        states.append(status.select(F.lit(arm).alias("arm"), F.col("query_id").cast("bigint").alias("query_id"), "status"))
        seconds[arm] = time.perf_counter() - began
    ranked, status = runs[0], states[0]
    for more, state in zip(runs[1:], states[1:]):
        ranked, status = ranked.unionByName(more), status.unionByName(state)
    lists = ranked.groupBy("arm", "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "song_id"))), lambda s: s["song_id"]).alias("ranked"))
    asked = queries.crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in arms], "arm string")))  # as many rows as configurations
    outcomes = asked.join(lists, ["arm", "query_id"], "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    metrics = evaluation.query_metrics(outcomes).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"`{m}`")).alias(m) for m in METRICS])
    by_status = status.groupBy("arm", "status").agg(F.count(F.lit(1)).alias("n"))
    return metrics, by_status, pooling.pool(ranked, pool_depth), seconds
