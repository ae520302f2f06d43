"""Inverted tables: term frequencies, tf-idf weights and BM25 scores.

The corpus is tokenised once into (doc, term, tf); everything after that is
joins on the term.  Vocabularies and query terms are counted and broadcast up
to a stated number of rows; beyond it the joins are salted by document or query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import counted_join, discard, materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of query terms (about 50 bytes each) that are broadcast at most.
BROADCAST_TERMS = 200_000


def postings(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, term, tf): how often each term occurs in each document."""
    return docs.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def smooth_idf(n: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.ln((1 + n) / (1 + df)) + 1


def df_of_smooth_idf(n: Column, idf: Column) -> Column:
    """The document frequency a smooth idf came from."""
    return (1 + n) / F.exp(idf - 1) - 1


def n_docs_of_max_idf(max_idf: Column) -> Column:
    """The corpus size that a highest idf implies if some term is in one document only."""
    return F.round(F.exp(max_idf - 1) * 2 - 1)


@dataclass
class TfIdf:
    """Fitted state: (term, df, idf), one row of totals, and the postings it was fitted on."""

    idf: DataFrame
    totals: DataFrame
    postings: DataFrame | None = None


def fit_tfidf(docs: DataFrame, doc: str, tokens: Column, max_features: int | None = None) -> TfIdf:
    """Vocabulary with df and smooth idf; optionally only the terms of highest corpus frequency.

    The corpus is tokenised once; the written postings serve ``tfidf_vectors`` too.
    """
    # a document without any term has one row with a null term, so that the number of documents is in the table too
    each = docs.select(doc, F.explode_outer(tokens).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    table = materialize(each, "postings")
    n_docs = table.select(doc).distinct().count()
    post = table.where("term is not null")
    terms = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    if max_features is not None:
        terms = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    idf = materialize(terms.select("term", "df", smooth_idf(F.lit(n_docs), F.col("df")).alias("idf")), "idf")
    made = idf.agg(F.avg("idf").alias("mean_idf"), F.count(F.lit(1)).alias("n_terms")).first()
    totals = docs.sparkSession.createDataFrame([(n_docs, made.mean_idf, made.n_terms)], "n_docs bigint, mean_idf double, n_terms bigint")
    return TfIdf(idf, totals, post)


def tfidf_vectors(docs: DataFrame | None, doc: str, tokens: Column, model: TfIdf) -> DataFrame:
    """(doc, term, weight): raw counts times idf, rows of unit length; unknown terms are left out.

    ``docs`` None encodes the documents the model was fitted on, from its
    postings.  A document without any known term has no rows (see
    ``without_signal``).
    """
    post = model.postings if docs is None else postings(docs, doc, tokens)
    # a vocabulary is counted; up to BROADCAST_TERMS rows it is broadcast and the postings stay where they are
    post = counted_join(post, model.idf.select("term", "idf"), ["term"], F.col(doc), most=BROADCAST_TERMS)
    weighed = post.select(doc, "term", (F.col("tf") * F.col("idf")).alias("w"))
    # the terms of one document are never more than its text
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return weighed.select(doc, "term", (F.col("w") / norm).alias("weight"))


def without_signal(docs: DataFrame, doc: str, vectors: DataFrame) -> DataFrame:
    """Documents that have no vector."""
    return docs.select(doc).distinct().join(vectors.select(doc).distinct(), doc, "left_anti")


def sparse_scores(queries: DataFrame, query: str, corpus: DataFrame, doc: str, counted: DataFrame | None = None) -> DataFrame:
    """(query, doc, score): dot products of the pairs that share a term; ``counted`` as in ``_meet``."""
    met = _meet(queries.select(query, "term", F.col("weight").alias("qw")), corpus.select(doc, "term", F.col("weight").alias("dw")), query, doc, counted)
    return met.groupBy(query, doc).agg(F.sum(F.col("qw") * F.col("dw")).alias("score"))


def _meet(queries: DataFrame, corpus: DataFrame, query: str, doc: str, counted: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """Join of query terms and postings on the term.

    The query side is written and counted, or a written table that has no
    fewer rows (``counted``) is: up to ``BROADCAST_TERMS`` rows it is
    broadcast and the postings stay where they are; beyond that the postings
    of a hot term are parted by document and the query side copied.
    """
    if counted is None:
        counted = queries = materialize(queries, "query_terms")
    if counted.count() <= BROADCAST_TERMS:
        return corpus.join(F.broadcast(queries), "term")
    left = corpus.withColumn("__salt", F.pmod(F.xxhash64(doc), F.lit(salts)).cast("int"))
    right = queries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["term", "__salt"]).drop("__salt")


@dataclass
class Bm25:
    """(doc, term, tf, dl) postings, (term, df, idf) and one row (n_docs, avgdl, mean_idf)."""

    postings: DataFrame
    idf: DataFrame
    stats: DataFrame


def fit_bm25(docs: DataFrame, doc: str, tokens: Column) -> Bm25:
    """Okapi BM25; documents without tokens count in n_docs and in the average length.

    Negative idf values become a quarter of the mean idf, the mean taken before.
    """
    # a document without any token has one row with a null term; one shuffle by document serves both steps
    each = docs.select(doc, F.explode_outer(tokens).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    dl = F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("tf"))).over(Window.partitionBy(doc)), F.lit(0))
    table = materialize(each.withColumn("dl", dl), "postings")
    # the rows of a document lie together, so most of it is one row a document before the shuffle
    size = table.groupBy(doc).agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    post = table.where("term is not null")
    idf, mean = bm25_idf(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), size.n_docs)
    stats = docs.sparkSession.createDataFrame([(size.n_docs, size.avgdl, mean)], "n_docs bigint, avgdl double, mean_idf double")
    return Bm25(post, idf, stats)


def bm25_idf(terms: DataFrame, n_docs: int) -> tuple[DataFrame, float | None]:
    """(term, df, idf) of all terms (term, df), and the mean of the idf before negative ones are replaced."""
    n, df = F.lit(n_docs), F.col("df")
    raw = materialize(terms.select("term", "df", (F.ln(n - df + 0.5) - F.ln(df + 0.5)).alias("raw")), "bm25_idf")
    mean = raw.agg(F.avg("raw").alias("m")).first().m
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(F.col("raw")).alias("idf")), mean


def save_bm25(model: Bm25, path: str) -> None:
    """Write the index: postings sorted by term, so that a search reads the row groups of its terms only."""
    model.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
    model.idf.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/idf")
    model.stats.write.parquet(f"{path}/stats")


def load_bm25(spark: SparkSession, path: str) -> Bm25:
    return Bm25(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "idf", "stats")))


#: Distinct terms that are pushed down to the scan of an index as a list at most.
PUSHED_TERMS = 2_000


def few_terms(asked: DataFrame) -> list[str] | None:
    """The distinct terms that are asked for, if they are few."""
    terms = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return terms if len(terms) <= PUSHED_TERMS else None


def of_terms(rows: DataFrame, terms: list[str] | None) -> DataFrame:
    """The rows of a few terms, by a filter that reaches the scan; all rows where the terms are many."""
    return rows if terms is None else rows.where(F.col("term").isin(terms))


def query_bag(queries: DataFrame, query: str, tokens: Column) -> DataFrame:
    """(query, term, qtf): the tokens of each query with repetition counted."""
    return postings(queries, query, tokens).withColumnRenamed("tf", "qtf")


def bm25_scores(bag: DataFrame, query: str, model: Bm25, doc: str) -> DataFrame:
    """(query, doc, score) of all documents that hold a query token; ``bag`` should be a written table."""
    known = counted_join(bag, model.idf.select("term", "idf"), ["term"], F.col(query), most=BROADCAST_TERMS)
    met = _meet(known, model.postings, query, doc, bag).crossJoin(F.broadcast(model.stats.select("avgdl")))
    tf, dl = F.col("tf"), F.col("dl")
    gain = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return met.groupBy(query, doc).agg(F.sum(gain).alias("score"))
