"""Embedders: averaged word vectors natively, neural ones behind an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import salted_join
from . import postings as inv

E5_PREFIX = {True: "query: ", False: "passage: "}


def fit_word_idf(docs: DataFrame, doc: str, text: str) -> inv.TfIdf:
    """Smooth idf over lexical tokens; mean_idf of the totals stands in for unknown words."""
    return inv.fit_tfidf(docs, doc, tx.tokenize_words(F.col(text)))


def average_word_vectors(docs: DataFrame, doc: str, text: str, words: DataFrame, model: inv.TfIdf) -> DataFrame:
    """(doc, embedding): idf-weighted mean of the words' vectors with repetition, of unit length.

    ``words`` is (word, vector).  Words without a vector are skipped; words
    without an idf weigh the mean idf.  Documents without any vector are left
    out (they have no signal).
    """
    post = inv.postings(docs, doc, tx.tokenize_words(F.col(text)))
    table = words.select(F.col("word").alias("term"), "vector").join(model.idf.select("term", "idf"), "term", "left")
    table = table.crossJoin(F.broadcast(model.totals.select("mean_idf"))).select("term", "vector", F.coalesce("idf", "mean_idf").alias("idf"))
    met = salted_join(post, table, ["term"], F.col(doc))
    sums = met.select(doc, F.posexplode("vector").alias("dim", "x"), (F.col("tf") * F.col("idf")).alias("w")).groupBy(doc, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    rows = sums.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))  # as many entries as dimensions
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.where(n > 1e-6).select(doc, F.transform("v", lambda x: (x / n).cast("float")).alias("embedding"))


def with_prefix(text: Column, is_query: bool) -> Column:
    """What an e5 model is given."""
    return F.concat(F.lit(E5_PREFIX[is_query]), text)


def neural_vectors(docs: DataFrame, doc: str, text: str, model_name: str, *, is_query: bool = False, prefix: bool = False, batch_size: int = 16) -> DataFrame:
    """(doc, embedding) by a sentence-transformers model, loaded once per Python worker."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as e:
        raise RuntimeError(f"embedder {model_name!r} needs sentence-transformers, which is not installed") from e
    source = docs.select(doc, (with_prefix(F.col(text), is_query) if prefix else F.col(text)).alias("text"))

    def run(batches):
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(model_name)
        for pdf in batches:
            vectors = model.encode(pdf["text"].tolist(), batch_size=batch_size, normalize_embeddings=True)
            yield pdf[[doc]].assign(embedding=list(vectors))

    return source.mapInPandas(run, f"{doc} {docs.schema[doc].dataType.simpleString()}, embedding array<float>")


def embedding_report(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: count, dimension, lowest and highest norm, rows of unit length, rows without signal."""
    from ..functions.vectors import NO_SIGNAL, UNIT_TOLERANCE, norm

    n = norm(F.col(vector))
    return vectors.select(n.alias("n"), F.size(vector).alias("d")).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.max("d").alias("dim"),
        F.round(F.min("n"), 6).alias("norm_min"),
        F.round(F.max("n"), 6).alias("norm_max"),
        F.coalesce(F.sum((F.abs(F.col("n") - 1) <= UNIT_TOLERANCE).cast("bigint")), F.lit(0)).alias("n_unit"),
        F.coalesce(F.sum((F.col("n") <= NO_SIGNAL).cast("bigint")), F.lit(0)).alias("n_no_signal"),
    )


def overflow_report(docs: DataFrame, lengths: Column, limit: int) -> DataFrame:
    """One row: texts longer than a model takes, and the longest."""
    return docs.select(lengths.alias("n")).agg(F.coalesce(F.sum((F.col("n") > limit).cast("bigint")), F.lit(0)).alias("n_over"), F.max("n").alias("longest"))


def overflow_sample(docs: DataFrame, doc: str, lengths: Column, limit: int, n: int = 5) -> DataFrame:
    """(doc, n_tokens): the first ``n`` texts, by id, that are longer than a model takes."""
    return docs.select(doc, lengths.alias("n_tokens")).where(F.col("n_tokens") > limit).orderBy(doc).limit(n)


def token_lengths(docs: DataFrame, doc: str, text: str, tokenizer_file: str, *, is_query: bool = False, prefix: bool = False) -> DataFrame:
    """(doc, n_tokens) by a tokenizer file, special tokens included, of what a model would be given; null texts have 0."""
    given = F.coalesce(with_prefix(F.col(text), is_query) if prefix else F.col(text), F.lit(""))

    def run(batches):
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer_file)
        encoder.no_truncation()
        for pdf in batches:
            lengths = [len(e.ids) for at in range(0, len(pdf), 1000) for e in encoder.encode_batch(pdf["text"].iloc[at : at + 1000].tolist())]
            yield pdf[[doc]].assign(n_tokens=lengths)

    return docs.select(doc, given.alias("text")).mapInPandas(run, f"{doc} {docs.schema[doc].dataType.simpleString()}, n_tokens int")


def half_precision(vectors: DataFrame, item: str, vector: str = "embedding") -> DataFrame:
    """Vectors rounded through 16-bit floats, as stored vectors are."""
    import numpy as np

    def run(batches):
        for pdf in batches:
            pdf[vector] = [np.asarray(v, dtype=np.float16).astype(np.float32) for v in pdf[vector]]
            yield pdf

    return vectors.select(item, vector).mapInPandas(run, f"{item} {vectors.schema[item].dataType.simpleString()}, {vector} array<float>")


def save_model(model: inv.TfIdf, path: str) -> None:
    model.idf.write.mode("errorifexists").parquet(f"{path}/idf")
    model.totals.write.mode("errorifexists").parquet(f"{path}/totals")


def load_model(spark, path: str) -> inv.TfIdf:
    return inv.TfIdf(spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/totals"))


