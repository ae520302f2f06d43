"""Queries of the indexes, retrievers, fusion and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import embedders, evaluation, fusion, knn, retrieval
from ..operators import postings as inv
from ..runtime import counted_join, materialize, table
from .base import ALL_SEARCHES, BEST_CHUNK, BM25, CHUNKS, DENSE, EVERY, HITS, HYBRID, SEARCHES, SONGS, TFIDF, chunks, eval_queries, hits, query, searches, songs, strip_sql

_LEX = f"WITH {SONGS}, {CHUNKS}, {SEARCHES}, {BM25}, {BEST_CHUNK}"
_DENSE = f"WITH {CHUNKS}, {SEARCHES}, {DENSE}"
_LEX_ALL = f"WITH {SONGS}, {CHUNKS}, {ALL_SEARCHES}, {BM25}, {BEST_CHUNK}"
_DENSE_ALL = f"WITH {CHUNKS}, {ALL_SEARCHES}, {DENSE}"
_HYBRID_ALL = f"WITH {SONGS}, {CHUNKS}, {ALL_SEARCHES}, {BM25}, {BEST_CHUNK}, {DENSE}, {HYBRID}"
_HYBRID = f"WITH {SONGS}, {CHUNKS}, {SEARCHES}, {BM25}, {BEST_CHUNK}, {DENSE}, {HYBRID}"


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, inv.TfIdf]:
    corpus = chunks(spark, d)
    return corpus, inv.fit_tfidf(corpus, "chunk_id", tx.tfidf_terms(F.col("text")))


@query(f"WITH {CHUNKS}, {TFIDF} SELECT term, df, round(idf, 6) AS idf FROM cidf")
def tfidf_idf(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)[1].idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {CHUNKS}, {TFIDF} SELECT term, df, round(idf, 6) AS idf FROM cidf ORDER BY cf DESC, term LIMIT 200")
def tfidf_max_features(spark: SparkSession, d: str) -> DataFrame:
    model = inv.fit_tfidf(chunks(spark, d), "chunk_id", tx.tfidf_terms(F.col("text")), max_features=200)
    return model.idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {CHUNKS}, {TFIDF} SELECT chunk_id, term, round(weight, 6) AS weight FROM cvec")
def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    corpus, model = _terms(spark, d)
    return inv.tfidf_vectors(None, "chunk_id", tx.tfidf_terms(F.col("text")), model).select("chunk_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {CHUNKS}, {TFIDF} SELECT chunk_id FROM chunks1 WHERE chunk_id NOT IN (SELECT chunk_id FROM cvec)")
def no_signal_chunks(spark: SparkSession, d: str) -> DataFrame:
    corpus, model = _terms(spark, d)
    return inv.without_signal(corpus, "chunk_id", inv.tfidf_vectors(None, "chunk_id", tx.tfidf_terms(F.col("text")), model))


@query(
    f"""WITH {CHUNKS}, {TFIDF} SELECT (SELECT count(*) FROM chunks1) AS n_chunks, (SELECT count(*) FROM cidf) AS n_terms, count(*) AS n_nonzero,
    count(DISTINCT chunk_id) AS n_vectors, (SELECT round(max(idf), 6) FROM cidf) AS max_idf, (SELECT round(exp(max(idf) - 1) * 2 - 1) FROM cidf) AS implied_docs FROM cvec"""
)
def tfidf_report(spark: SparkSession, d: str) -> DataFrame:
    corpus, model = _terms(spark, d)
    v = inv.tfidf_vectors(None, "chunk_id", tx.tfidf_terms(F.col("text")), model)
    top = model.idf.agg(F.max("idf").alias("m")).select(F.round("m", 6).alias("max_idf"), inv.n_docs_of_max_idf(F.col("m")).alias("implied_docs"))
    sizes = model.totals.select(F.col("n_docs").alias("n_chunks"), "n_terms")
    return sizes.crossJoin(v.agg(F.count(F.lit(1)).alias("n_nonzero"), F.count_distinct("chunk_id").alias("n_vectors"))).crossJoin(top)


@query(f"WITH {SONGS}, {SEARCHES}, {BM25} SELECT n_docs, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM st, mi")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = inv.fit_bm25(songs(spark, d), "song_id", tx.tokenize_words(F.coalesce("text_raw", F.lit("")))).stats
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@query(f"WITH {SONGS}, {SEARCHES}, {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    model = inv.fit_bm25(songs(spark, d), "song_id", tx.tokenize_words(F.coalesce("text_raw", F.lit(""))))
    return model.idf.select("term", "df", F.round("idf", 6).alias("idf"))


def _branches(spark: SparkSession, d: str, asked: DataFrame, k: int = 50, best_chunks: bool = True) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Dense and lexical retrieval of one query set, both from chunks that are written once."""
    c = materialize(chunks(spark, d).select("chunk_id", "song_id", "position", "text"), "chunks")
    return retrieval.dense_sparse_search(asked, c, k), retrieval.lexical_search(asked, songs(spark, d), c if best_chunks else None, k)


def _hybrid_statuses(spark: SparkSession, d: str) -> DataFrame:
    # a query has hits if its best one is a hit
    return retrieval.hybrid(*_branches(spark, d, searches(spark, d), 1, best_chunks=False))[1]


@query(f"{_LEX_ALL} SELECT query_id, song_id, score, best_chunk_id, rank FROM lexical")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_search(eval_queries(spark, d), songs(spark, d), chunks(spark, d))[0]


@query(
    f"""{_LEX} SELECT query_id, CASE WHEN {strip_sql("coalesce(query, '')")} = '' THEN 'empty_query' WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'query_out_of_vocabulary' END AS status,
    CASE WHEN {strip_sql("coalesce(query, '')")} = '' THEN 0 ELSE coalesce(n, 0) END::DOUBLE AS query_norm
    FROM searches LEFT JOIN (SELECT query_id, sum(qtf) AS n FROM bag JOIN idf USING (term) GROUP BY 1) USING (query_id)"""
)
def lexical_status(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_statuses(searches(spark, d), songs(spark, d))


@query(f"{_DENSE_ALL} SELECT query_id, song_id, score, best_chunk_id, rank FROM dense")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    c = materialize(chunks(spark, d).select("chunk_id", "song_id", "text"), "chunks")
    return retrieval.dense_sparse_search(eval_queries(spark, d), c)[0].select("query_id", "song_id", "score", "best_chunk_id", "rank")


@query(f"{_DENSE} SELECT query_id, chunk_id, score, crank AS rank FROM dtop WHERE crank <= 10")
def sparse_knn(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sparse_chunks(searches(spark, d), chunks(spark, d), 10)[0]


@query(f"{_HYBRID} SELECT query_id, song_id, round(score, 9) AS score, best_chunk_id, n_lists, best_rank, rank FROM hybrid")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(*_branches(spark, d, searches(spark, d)))[0].withColumn("score", F.round("score", 9))


@query(
    f"""{_HYBRID}, s AS (SELECT query_id, {strip_sql("coalesce(query, '')")} = '' AS blank, query_id IN (SELECT query_id FROM qvec) AS dk, query_id IN (SELECT query_id FROM bag JOIN idf USING (term)) AS lk FROM searches)
SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM lists) THEN 'ok' WHEN blank THEN 'empty_query' ELSE 'query_out_of_vocabulary' END AS status,
    CASE WHEN blank THEN 'empty_query' WHEN dk THEN 'ok' ELSE 'query_out_of_vocabulary' END AS dense_status, CASE WHEN blank THEN 'empty_query' WHEN lk THEN 'ok' ELSE 'query_out_of_vocabulary' END AS lexical_status FROM s"""
)
def hybrid_status(spark: SparkSession, d: str) -> DataFrame:
    s = _hybrid_statuses(spark, d)
    return s.select("query_id", "status", F.col("branch_statuses")["dense"].alias("dense_status"), F.col("branch_statuses")["lexical"].alias("lexical_status"))


@query(f"{_HYBRID_ALL} SELECT query_id, rank, song_id, artist, title, round(score, 4) AS score FROM hybrid LEFT JOIN songs1 USING (song_id) WHERE rank <= 10")
def shown_results(spark: SparkSession, d: str) -> DataFrame:
    h = retrieval.hybrid(*_branches(spark, d, eval_queries(spark, d), best_chunks=False))[0]
    return retrieval.show_hits(h, songs(spark, d), None)


@query(
    f"""{_HYBRID}, s AS (SELECT query_id, {strip_sql("coalesce(query, '')")} = '' AS blank FROM searches)
SELECT CASE WHEN blank THEN 'empty_query' ELSE 'query_out_of_vocabulary' END AS status, count(*) AS n FROM s WHERE query_id NOT IN (SELECT query_id FROM lists) GROUP BY 1"""
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.status_histogram(_hybrid_statuses(spark, d))


# vectors: the label of an embedding stands for the song of a chunk
_V = f"""q AS (SELECT vec_id::VARCHAR AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % {EVERY} = 0),
v AS (SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS song_id, embedding::DOUBLE[] AS cv FROM embeddings),
s AS (SELECT query_id, chunk_id, song_id, round(list_dot_product(qv, cv), 6) AS score FROM q, v),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return q, e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("song_id"), "embedding")


@query(f"WITH {_V} SELECT query_id, chunk_id, score, rank FROM top")
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    return knn.exact_top_k(*_vectors(spark, d), 10)


@query(f"""WITH {_V}, m AS (SELECT query_id, song_id, max(score) AS score, arg_min(chunk_id, rank) AS best_chunk_id FROM top GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM m""")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_search(*_vectors(spark, d), 10)[0].select("query_id", "song_id", "score", "best_chunk_id", "rank")


@query(f"""WITH {_V}, m AS (SELECT query_id, song_id, max(score) AS score FROM s GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM m) WHERE rank <= 5""")
def prototype_search(spark: SparkSession, d: str) -> DataFrame:
    """Best score per song over all chunks, without a limit on chunks, first five songs."""
    return knn.exact_top_groups(*_vectors(spark, d), 5, "song_id")


# the index is fitted, so SQL states only what it must reach
@query(f"WITH {_V} SELECT count(*) AS n_exact, true AS recall_reached FROM top")
def approximate_overlap(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    shared = knn.overlap(knn.exact_top_k(q, v, 10), knn.approximate_top_k(q, v, 10))
    return shared.agg(F.sum("n_a").alias("n_exact"), (F.sum("n_shared") >= 0.9 * F.sum("n_a")).alias("recall_reached"))


@query("""SELECT count(*) AS n_vectors, max(len(embedding)) AS dim, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max, sum((abs(n - 1) <= 0.01001)::INT)::BIGINT AS n_unit, sum((n <= 1e-6)::INT)::BIGINT AS n_no_signal
FROM (SELECT embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def embedding_report(spark: SparkSession, d: str) -> DataFrame:
    return embedders.embedding_report(table(spark, d, "embeddings")).withColumn("dim", F.col("dim").cast("bigint"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vec.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {CHUNKS} SELECT sum((len(regexp_extract_all(text, '\\S+')) > 200)::INT)::BIGINT AS n_over, max(len(regexp_extract_all(text, '\\S+'))) AS longest FROM chunks1")
def overflow_report(spark: SparkSession, d: str) -> DataFrame:
    r = embedders.overflow_report(chunks(spark, d), tx.word_count(F.col("text")), 200)
    return r.withColumn("longest", F.col("longest").cast("bigint"))


# word vectors: the character codes of a word, three numbers a word
_WV = "wv AS (SELECT word, [ascii(word)::DOUBLE / 100, length(word)::DOUBLE, ascii(reverse(word))::DOUBLE / 100] AS vector FROM (SELECT DISTINCT term AS word FROM t) WHERE length(word) % 2 = 0)"


@query(
    rf"""WITH {CHUNKS}, t AS (SELECT chunk_id, lower(unnest(regexp_extract_all(text, '[A-Za-z'']+'))) AS term FROM chunks1), {_WV},
p AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM chunks1),
i AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM p, n GROUP BY term),
a AS (SELECT chunk_id, sum(tf * idf * vector[1]) / sum(tf * idf) AS x, sum(tf * idf * vector[2]) / sum(tf * idf) AS y, sum(tf * idf * vector[3]) / sum(tf * idf) AS z FROM p JOIN i USING (term) JOIN wv ON word = term GROUP BY 1)
SELECT chunk_id, round((x / sqrt(x * x + y * y + z * z))::FLOAT::DOUBLE, 5) AS x, round((y / sqrt(x * x + y * y + z * z))::FLOAT::DOUBLE, 5) AS y, round((z / sqrt(x * x + y * y + z * z))::FLOAT::DOUBLE, 5) AS z FROM a"""
)
def word_vector_embeddings(spark: SparkSession, d: str) -> DataFrame:
    corpus = chunks(spark, d)
    model = embedders.fit_word_idf(corpus, "chunk_id", "text")
    w = F.col("term")
    words = model.idf.where(F.length(w) % 2 == 0).select(w.alias("word"), F.array(F.ascii(w) / 100.0, F.length(w).cast("double"), F.ascii(F.reverse(w)) / 100.0).alias("vector"))
    e = embedders.average_word_vectors(corpus, "chunk_id", "text", words, model)
    return e.select("chunk_id", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(c) for i, c in enumerate("xyz")])


_RANKED = f"""{HITS}, turned AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, arm ORDER BY CASE WHEN higher_is_better THEN -score ELSE score END, song_id) AS rank
    FROM hits1 h JOIN retrieval_configs USING (arm))"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The hits table as ranked lists, one per query and arm."""
    arms = table(spark, d, "retrieval_configs").select("arm", "higher_is_better")
    h = counted_join(hits(spark, d), arms, ["arm"], F.col("song_id"))
    key = F.when(F.col("higher_is_better"), -F.col("score")).otherwise(F.col("score"))
    return fusion.top_k(h.withColumn("key", key), ["query_id", "arm"], [F.asc("key"), F.asc("song_id")], 50).select("query_id", "arm", "song_id", "score", "rank")


@query(f"WITH {_RANKED} SELECT query_id, arm, song_id, rank FROM turned WHERE rank <= 50")
def ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).drop("score")


@query(
    f"""WITH {_RANKED}, f AS (SELECT query_id, song_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS n_lists, min(rank) AS best_rank FROM turned WHERE rank <= 50 GROUP BY ALL)
SELECT query_id, song_id, round(score, 9) AS score, n_lists, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_lists DESC, best_rank, song_id) AS rank FROM f"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_ranked(spark, d)).withColumn("score", F.round("score", 9))


@query(f"WITH {HITS} SELECT query_id, arm, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM hits1 GROUP BY ALL")
def arm_scores(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy("query_id", "arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))
