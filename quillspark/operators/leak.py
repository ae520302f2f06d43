"""Lexical leaks between queries and their sources, and what the leak gate leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, skewed_join

MAX_DF, MAX_ATTEMPTS = 100, 3


def weighted_overlap(pairs: DataFrame, key: list[str], query_terms: Column, source_terms: Column, idf: DataFrame) -> DataFrame:
    """Per key: ratio, weight_shared, weight_total, max_shared_idf, shared and unknown terms.

    Terms are sets.  Terms without an idf are unknown and in no weight.  The
    ratio is 0 without any weight, the highest idf 0 without shared terms.
    """
    both = pairs.select(*key, F.array_distinct(query_terms).alias("q"), F.coalesce(source_terms, F.array().cast("array<string>")).alias("s"))
    # a query's own terms with a mark whether its source has them: neither text nor terms of the source travel on
    marked = F.transform("q", lambda t: F.struct(t.alias("term"), F.array_contains("s", t).alias("in_source")))
    base = materialize(both.select(*key, marked.alias("terms")), "pairs")
    terms = materialize(base.select(*key, F.explode("terms").alias("t")).select(*key, "t.*"), "pair_terms")
    joined = skewed_join(terms, idf.select("term", "idf"), ["term"], F.struct(*key), "left")
    shared = F.col("in_source") & F.col("idf").isNotNull()
    sums = joined.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(shared, F.col("idf"))), F.lit(0.0)).alias("weight_shared"),
        F.coalesce(F.sum("idf"), F.lit(0.0)).alias("weight_total"),
        F.coalesce(F.max(F.when(shared, F.col("idf"))), F.lit(0.0)).alias("max_shared_idf"),
        F.sort_array(F.collect_set(F.when(shared, F.col("term")))).alias("shared"),  # one query's own terms
        F.sort_array(F.collect_set(F.when(F.col("idf").isNull(), F.col("term")))).alias("unknown"),
    )
    out = base.select(*key).join(sums, key, "left").na.fill(0.0, ["weight_shared", "weight_total", "max_shared_idf"])
    empty = F.array().cast("array<string>")
    out = out.withColumns({"shared": F.coalesce("shared", empty), "unknown": F.coalesce("unknown", empty)})
    return out.withColumn("ratio", F.when(F.col("weight_total") > 0, F.col("weight_shared") / F.col("weight_total")).otherwise(F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two term arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def gate(scores: DataFrame, gate_idf: float) -> DataFrame:
    """Attempts with ``passes``: no shared term as rare as the gate's idf."""
    return scores.withColumn("passes", F.col("max_shared_idf") < F.lit(gate_idf))


def attrition(attempts: DataFrame, key: list[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per key: its first passing attempt, the attempts made, and passed / exhausted / pending."""
    per_key = attempts.groupBy(*key).agg(F.min(F.when(F.col("passes"), F.col("attempt"))).alias("first_pass"), F.max("attempt").alias("n_attempts"))
    state = F.when(F.col("first_pass").isNotNull(), "passed").when(F.col("n_attempts") >= max_attempts, "exhausted").otherwise("pending")
    return per_key.withColumn("state", state)


def failure_by_attempt(attempts: DataFrame) -> DataFrame:
    """Per attempt: how many were made, how many failed, and the rate."""
    failed = F.sum((~F.col("passes")).cast("bigint"))
    return attempts.where("passes is not null").groupBy("attempt").agg(F.count(F.lit(1)).alias("n"), failed.alias("n_failed"), (failed / F.count(F.lit(1))).alias("fail_rate"))


def in_all_arms(rows: DataFrame, arm: str, key: str) -> DataFrame:
    """Keys that every arm has: the base of a paired comparison."""
    arms = rows.select(arm).distinct().agg(F.count(F.lit(1)).alias("n_arms"))
    per_key = rows.select(arm, key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.crossJoin(F.broadcast(arms)).where("n = n_arms").select(key)


def contamination(fragments: DataFrame, queries: DataFrame, idf: DataFrame, query_terms: Column, group_size: int = 25) -> DataFrame:
    """Per query: the other fragment of its group with the highest shared idf, that idf, and the terms that have it.

    Fragments (fragment_id, terms, group_no) meet queries (query_id,
    fragment_id, group_no, ...) of the same group but another fragment.  The
    join is on group and term, so only fragments that share a term meet.
    """
    q = queries.select("query_id", F.col("fragment_id").alias("own"), "group_no", F.explode(F.array_distinct(query_terms)).alias("term"))
    f = fragments.select("fragment_id", "group_no", F.explode(F.array_distinct("terms")).alias("term"))
    # a group is ``group_size`` fragments, so a (group, term) pair meets few; many queries of one fragment are spread
    q = materialize(q, "group_terms")
    met = skewed_join(q, f, ["group_no", "term"], F.col("query_id")).where(F.col("own") != F.col("fragment_id"))
    met = skewed_join(met, idf.select("term", "idf"), ["term"], F.col("query_id"), counted=q)
    held = F.collect_set(F.struct(F.round("idf", 6).alias("idf"), "term"))  # within one query's own terms
    per_pair = met.groupBy("query_id", "fragment_id").agg(F.round(F.max("idf"), 6).alias("idf"), held.alias("held"))
    top = F.sort_array(F.transform(F.filter("held", lambda h: h["idf"] >= F.col("idf")), lambda h: h["term"]))
    worst = F.min(F.struct((-F.col("idf")).alias("neg"), F.col("fragment_id").alias("fragment_id"), top.alias("terms"))).alias("m")
    found = per_pair.groupBy("query_id").agg(worst)
    return found.select("query_id", F.col("m.fragment_id").alias("other_fragment"), (-F.col("m.neg")).alias("max_other_idf"), F.col("m.terms").alias("cross_terms"))
