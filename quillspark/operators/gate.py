"""The leak gate over generated queries: scored attempts, what is accepted, what is tried again, and reports.

A reply is a row (chunk_id, attempt, paraphrase, description); an attempt is
one query of it.  Everything is keyed by (chunk_id, query_type) and stays a
handful of joins and aggregates, whatever the number of replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import materialize, skewed_join
from . import leak, pooling
from .postings import smooth_idf

QUERY_TYPES = ("paraphrase", "description")
KEY = ["chunk_id", "query_type"]


def terms(text: Column) -> Column:
    return tx.tfidf_terms(F.coalesce(text, F.lit("")))


def long_replies(replies: DataFrame, *more: str) -> DataFrame:
    """(*more, chunk_id, attempt, query_type, text): one row per query that a reply carries; an attempt without a number is the first."""
    each = F.array(*[F.struct(F.lit(t).alias("query_type"), F.col(t).alias("text")) for t in QUERY_TYPES])
    rows = replies.select(*more, "chunk_id", F.coalesce("attempt", F.lit(1)).alias("attempt"), F.explode(each).alias("r"))
    return rows.select(*more, "chunk_id", "attempt", "r.*").where("text is not null")


def score_attempts(attempts: DataFrame, fragments: DataFrame, songs: DataFrame, idf: DataFrame, n_docs: int, max_df: int = leak.MAX_DF) -> DataFrame:
    """The attempts (chunk_id, query_type, attempt, text) with their overlap with the source, the title control, and ``passes``.

    ``fragments``: chunk_id, song_id, text and what else is known of them.
    max_shared_df is the document frequency behind the rarest shared term,
    null without any; meta_max_idf is the rarest term shared with title or
    artist, 0 without any.  An attempt on an unknown fragment has no source
    and so passes.
    """
    key = [*KEY, "attempt"]
    known = fragments.join(songs.select("song_id", F.concat_ws(" ", "title", "artist").alias("meta")), "song_id", "left")
    rows = materialize(skewed_join(materialize(attempts, "attempts"), known.withColumnRenamed("text", "source"), ["chunk_id"], F.col("text"), "left"), "gate")
    scores = leak.weighted_overlap(rows, key, terms(F.col("text")), terms(F.col("source")), idf)
    shown = rows.select(*key, F.explode(F.array_intersect(terms(F.col("text")), terms(F.col("meta")))).alias("term"))
    control = shown.join(idf.select("term", "idf"), "term").groupBy(*key).agg(F.max("idf").alias("meta_max_idf"))
    gate_idf = smooth_idf(F.lit(n_docs), F.lit(max_df))
    out = rows.drop("source", "meta").join(scores, key).join(control, key, "left").na.fill(0.0, ["meta_max_idf"])
    df = F.when(F.col("max_shared_idf") > 0, (1 + F.lit(n_docs)) / F.exp(F.col("max_shared_idf") - 1) - 1)
    n_terms, n_words = F.size(F.array_distinct(terms(F.col("text")))), tx.word_count(F.col("text"))
    # compared as both are reported, so that a term of just the gate's frequency fails whatever the last bit says
    passes = F.round("max_shared_idf", 6) < F.round(gate_idf, 6)
    return out.withColumns({"max_shared_df": df, "n_terms": n_terms, "n_words": n_words, "passes": passes, "title_leak": F.round("meta_max_idf", 6) >= F.round(gate_idf, 6)})


def accepted(scored: DataFrame) -> DataFrame:
    """The first passing attempt of each key, as the row of an evaluation set with its chunk."""
    rest = [c for c in ("text", "song_id", "stratum") if c in scored.columns]
    first = F.min(F.struct("attempt", *rest)).alias("m")
    best = scored.where("passes").groupBy(*KEY).agg(first).select(*KEY, "m.*")
    stratum = F.col("stratum") if "stratum" in scored.columns else F.lit(None).cast("string")
    return best.select(*KEY, F.col("text").alias("query"), F.array("song_id").alias("relevant_song_ids"), stratum.alias("stratum"), "attempt")


def retries(scored: DataFrame, max_attempts: int = leak.MAX_ATTEMPTS) -> DataFrame:
    """(chunk_id): fragments with a query that has not passed and may be tried again."""
    return leak.attrition(scored, KEY, max_attempts).where("state = 'pending'").select("chunk_id").distinct()


def attrition_report(scored: DataFrame, max_attempts: int = leak.MAX_ATTEMPTS) -> DataFrame:
    """Per query type and stratum: keys by state, how many were tried again and failed again, and the rate.

    repeat_fail_rate is null where nothing was tried again.
    """
    state = leak.attrition(scored, KEY, max_attempts)
    strata = scored.groupBy(*KEY).agg(F.min("stratum").alias("stratum"))
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    again = F.col("n_attempts") > 1
    failed = again & (F.col("state") != "passed")
    return state.join(strata, KEY).groupBy("query_type", "stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[count(F.col("state") == s).alias(s) for s in ("passed", "exhausted", "pending")],
        count(again).alias("n_retried"),
        count(failed).alias("n_failed_again"),
        (count(failed) / F.nullif(count(again), F.lit(0))).alias("repeat_fail_rate"),
    )


def attrition_totals(scored: DataFrame, max_attempts: int = leak.MAX_ATTEMPTS) -> DataFrame:
    """One row: accepted queries, texts accepted more than once, fragments that lost their paraphrase, fragments to try again."""
    ok = accepted(scored)
    twice = ok.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lost = leak.attrition(scored, KEY, max_attempts).where("state = 'exhausted' and query_type = 'paraphrase'")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = one(ok, "n_accepted").crossJoin(one(twice, "n_duplicate_texts"))
    return row.crossJoin(one(lost, "n_lost_paraphrase")).crossJoin(one(retries(scored, max_attempts), "n_retry"))


def first_attempts(scored: DataFrame) -> DataFrame:
    """Per query type, of first attempts: lengths, overlap, the worst shared idf, gate failures and title leaks."""
    failed = lambda c: F.sum(c.cast("bigint"))
    return scored.where("attempt = 1").groupBy("query_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean_words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"),
        F.avg("ratio").alias("mean_ratio"), F.max("ratio").alias("max_ratio"), F.max("max_shared_idf").alias("worst_idf"),
        failed(~F.col("passes")).alias("n_failed"), failed(F.col("title_leak")).alias("n_title_leaks"),
    )


def assemble(scored: DataFrame, fragments: DataFrame, *, partial: bool = False, max_df: int = leak.MAX_DF, max_attempts: int = leak.MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame, dict]:
    """(evaluation set, retry list, description).

    Raises where fragments have no reply, unless ``partial``: a set that is
    smaller than its design has to say so.
    """
    missing = pooling.missing_replies(fragments, scored, "chunk_id").count()
    if missing and not partial:
        raise ValueError(f"{missing} fragments have no reply; finish the generation, or ask for a partial set")
    ok = materialize(accepted(scored), "accepted")
    counts = ok.agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("chunk_id").alias("songs")).first()
    meta = {"gate_df": max_df, "max_attempts": max_attempts, "songs": counts.songs, "queries": counts.queries, "partial": bool(missing)}
    return ok.select(*KEY, "query", "relevant_song_ids", "stratum"), retries(scored, max_attempts), meta


def arm_rows(replies: DataFrame, fragments: DataFrame, idf: DataFrame, n_docs: int, *, group_size: int = 25, max_df: int = leak.MAX_DF) -> DataFrame:
    """Every query of the fragments that all arms have, scored against its own fragment and the others of its group.

    ``replies``: arm, chunk_id, attempt, paraphrase, description.  Groups are
    ``group_size`` fragments in order of id, the same for all arms.
    """
    key = ["arm", *KEY]
    common = materialize(leak.in_all_arms(replies, "arm", "chunk_id"), "common")
    placed = materialize(pooling.grouped(common, "chunk_id", group_size), "placed")
    sources = materialize(fragments.select("chunk_id", F.col("text").alias("source")).join(placed, "chunk_id"), "sources")
    rows = long_replies(replies, "arm").drop("attempt").join(sources, "chunk_id")
    rows = materialize(rows.withColumn("query_id", F.concat_ws("|", *key)), "arm_rows")
    own = leak.weighted_overlap(rows, key, terms(F.col("text")), terms(F.col("source")), idf)
    others = sources.select(F.col("chunk_id").alias("fragment_id"), "group_no", terms(F.col("source")).alias("terms"))
    cross = leak.contamination(others, rows.withColumnRenamed("chunk_id", "fragment_id"), idf, terms(F.col("text")), group_size)
    out = rows.drop("source").join(own.select(*key, "ratio", F.col("max_shared_idf").alias("own_max_idf")), key).join(cross, "query_id", "left").drop("query_id")
    gate_idf = F.round(smooth_idf(F.lit(n_docs), F.lit(max_df)), 6)
    return out.withColumns({
        "cross_max_idf": F.coalesce("max_other_idf", F.lit(0.0)), "n_words": tx.word_count(F.col("text")),
        "passes": F.round("own_max_idf", 6) < gate_idf, "cross_over": F.round(F.coalesce("max_other_idf", F.lit(0.0)), 6) >= gate_idf,
    }).drop("max_other_idf")


def arm_reports(rows: DataFrame) -> dict[str, DataFrame]:
    """The five tables over ``arm_rows``: cross-fragment leaks, own overlap, gate failures, places in the group, lengths and pairs."""
    count = lambda c: F.sum(c.cast("bigint"))
    by = rows.groupBy("arm", "query_type")
    both = rows.groupBy("arm", "chunk_id").agg(*[F.max(F.when(F.col("query_type") == t, F.struct("n_words", "text"))).alias(t) for t in QUERY_TYPES])
    pair = leak.jaccard(F.array_distinct(terms(F.col("paraphrase.text"))), F.array_distinct(terms(F.col("description.text"))))
    both = both.select("arm", F.col("paraphrase.n_words").alias("p"), F.col("description.n_words").alias("d"), F.when(F.col("paraphrase").isNotNull() & F.col("description").isNotNull(), pair).alias("j"))
    return {
        "cross": by.agg(F.count(F.lit(1)).alias("n"), F.avg("cross_max_idf").alias("mean_idf"), F.max("cross_max_idf").alias("worst_idf"), count(F.col("cross_over")).alias("n_over")),
        "own": by.agg(F.avg("ratio").alias("mean_ratio"), F.avg("own_max_idf").alias("mean_idf"), F.max("own_max_idf").alias("worst_idf")),
        "failures": by.agg(F.count(F.lit(1)).alias("n"), count(~F.col("passes")).alias("n_failed")),
        "places": rows.groupBy("arm", "place").agg(F.count(F.lit(1)).alias("n"), count(~F.col("passes")).alias("n_failed"), F.avg("cross_max_idf").alias("mean_idf")),
        "lengths": both.groupBy("arm").agg(F.avg("p").alias("paraphrase_words"), F.avg("d").alias("description_words"), F.avg("j").alias("pair_jaccard")),
    }


def sample_counts(sample: DataFrame) -> DataFrame:
    """(what, value, n) of a drawn sample: by stratum, genre, translation, and fragments that open their song.

    Columns that the sample lacks are left out; rows with a ``skipped`` reason count by it alone.
    """
    parts = []
    usable = sample.where("skipped is null") if "skipped" in sample.columns else sample
    for c in ("stratum", "genre", "is_translation"):
        if c in sample.columns:
            parts.append(usable.select(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")))
    if "position" in sample.columns:
        parts.append(usable.where("position = 0").select(F.lit("position").alias("what"), F.lit("0").alias("value")))
    if "skipped" in sample.columns:
        parts.append(sample.where("skipped is not null").select(F.lit("skipped").alias("what"), F.col("skipped").alias("value")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))
