"""How distinctive a term is of a record, by correspondence-analysis residuals.

Method: the adjusted residual of a term in a record is the observed less the
expected count over the root of the expectation, adjusted for the variance
that the margins leave: (O - E) / sqrt(E (1 - r/N) (1 - c/N)) with E = r c / N,
r the words of the record, c the occurrences of the term, N all words.  Plain
DataFrame arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize, skewed_join

MAX_SHARE = 0.005
_WORD = r"[\p{L}\p{N}]+"


def word_list(text: Column) -> Column:
    """Longest runs of letters and digits, in lower case; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null key, of repeated rows the largest."""
    row = F.max(F.struct(*columns)).alias("m")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "m.*")


def term_statistics(records: DataFrame, text: str) -> DataFrame:
    """(term, n_occurrences, n_records) over all records, one row per term.

    A record gives its words and, beside them, its distinct words; only
    per-task partial sums per term are shuffled.
    """
    listed = records.select(word_list(F.col(text)).alias("w"))
    both = F.array(F.struct("w", F.lit(0).alias("distinct")), F.struct(F.array_distinct("w").alias("w"), F.lit(1).alias("distinct")))
    each = listed.select(F.inline(both)).select(F.explode("w").alias("term"), "distinct")
    return each.groupBy("term").agg(F.sum(1 - F.col("distinct")).alias("n_occurrences"), F.sum("distinct").alias("n_records"))


def shared_terms(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Terms of two characters or more that a query shares with its source chunk, with their weight.

    Columns: query_id, chunk_id, term, observed, n_chunk_words,
    n_occurrences, n_records, total_records, residual, idf.  Repeated rows of
    a query or chunk count once; queries without a source chunk, query text or
    shared term have no rows.  All chunks, those of null or blank text too,
    are in total_records.  The idf is ln((1 + n) / (1 + df)) + 1.
    """
    queries = one_per_key(queries, "query_id", "query", "source_chunk_id").where(F.col("source_chunk_id").isNotNull())
    asked = queries.select("query_id", F.col("source_chunk_id").alias("chunk_id"), F.explode(F.array_distinct(word_list(F.col("query")))).alias("term"))
    asked = materialize(asked.where(F.length("term") >= 2), "asked")
    # one shuffle takes the largest text of each chunk and marks the chunks that are asked for
    marks = asked.select("chunk_id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("stored"), F.lit(True).alias("source")).distinct()
    stored = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", "text", F.lit(True).alias("stored"), F.lit(False).alias("source"))
    chunks = stored.unionByName(marks).groupBy("chunk_id").agg(F.max("text").alias("text"), F.max("stored").alias("stored"), F.max("source").alias("source"))
    chunks = materialize(chunks.where("stored").drop("stored"), "chunks")
    counted = chunks.where("source").select("chunk_id", word_list(F.col("text")).alias("w"))
    counted = counted.select("chunk_id", F.size("w").alias("n_chunk_words"), F.explode("w").alias("term"))
    counted = counted.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("observed"), F.first("n_chunk_words").alias("n_chunk_words"))
    shared = materialize(skewed_join(asked, counted, ["chunk_id", "term"], F.col("query_id")), "shared")
    discard(asked)

    stats = materialize(term_statistics(chunks, "text"), "terms")
    words = stats.agg(F.sum("n_occurrences").alias("total_words"))
    records = chunks.agg(F.count(F.lit(1)).alias("total_records"))
    joined = skewed_join(shared, stats, ["term"], F.col("query_id"))
    joined = joined.join(F.broadcast(words.crossJoin(records)))  # a single row of totals
    n, r, c = F.col("total_words"), F.col("n_chunk_words"), F.col("n_occurrences")
    expected = r * c / n
    variance = expected * (1 - r / n) * (1 - c / n)
    residual = F.when(variance > 0, (F.col("observed") - expected) / F.sqrt(variance)).otherwise(F.lit(0.0))
    idf = F.ln((1 + F.col("total_records")) / (1 + F.col("n_records"))) + 1
    return joined.select("query_id", "chunk_id", "term", "observed", "n_chunk_words", "n_occurrences", "n_records", "total_records", residual.alias("residual"), idf.alias("idf"))


def rare_shared_terms(shared: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """(query_id, terms, residuals): per query its shared terms in at most ``max_share`` of all records, the most characteristic first, ties by term."""
    rare = shared.where(F.col("n_records") <= F.col("total_records") * F.lit(max_share))
    ordered = F.sort_array(F.collect_list(F.struct((-F.round("residual", 9)).alias("r"), "term", "residual")))  # within one query's own words
    return rare.groupBy("query_id").agg(ordered.alias("m")).select("query_id", F.col("m.term").alias("terms"), F.col("m.residual").alias("residuals"))


def leak_summary(shared: DataFrame) -> DataFrame:
    """Per query: its shared terms in order, the highest idf and the most characteristic term."""
    return shared.groupBy("query_id").agg(
        F.sort_array(F.collect_set("term")).alias("shared"),  # within one query's own words
        F.round(F.max("idf"), 6).alias("max_shared_idf"),
        F.round(F.max("residual"), 6).alias("max_residual"),
        F.min(F.struct((-F.round("residual", 9)).alias("r"), F.col("term").alias("t")))["t"].alias("top_term"),
    )
