"""Queries of the metrics, slices, leak gate, samples, pools and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.metrics import METRICS
from ..operators import evaluation as ev
from ..operators import gate, ingest, leak, pooling
from ..operators import postings as inv
from ..runtime import table
from .base import CHUNKS, EVALS, HITS, SONGS, TERMS, TFIDF, chunks, eval_queries, hits, query, songs, words_sql
from .search import _RANKED, _ranked

_OUT = f"""{_RANKED}, {EVALS}, arms AS (SELECT DISTINCT arm FROM turned),
rel AS (SELECT query_id, arm, list_distinct(relevant_song_ids) AS rel FROM evals1, arms),
o AS (SELECT r.query_id, r.arm, any_value(len(r.rel)) AS n_rel, min(CASE WHEN list_contains(r.rel, t.song_id) THEN t.rank END) AS first,
    count(CASE WHEN list_contains(r.rel, t.song_id) AND t.rank <= 1 THEN 1 END) AS h1, count(CASE WHEN list_contains(r.rel, t.song_id) AND t.rank <= 5 THEN 1 END) AS h5,
    count(CASE WHEN list_contains(r.rel, t.song_id) AND t.rank <= 10 THEN 1 END) AS h10,
    coalesce(sum(CASE WHEN list_contains(r.rel, t.song_id) AND t.rank <= 10 THEN 1 / log2(t.rank + 1) END), 0) AS dcg
    FROM rel r LEFT JOIN (SELECT * FROM turned WHERE rank <= 50) t ON r.query_id = t.query_id AND r.arm = t.arm GROUP BY ALL),
m AS (SELECT query_id, arm, CASE WHEN n_rel > 0 THEN h1 / n_rel ELSE 0 END AS "recall@1", CASE WHEN n_rel > 0 THEN h5 / n_rel ELSE 0 END AS "recall@5",
    CASE WHEN n_rel > 0 THEN h10 / n_rel ELSE 0 END AS "recall@10", coalesce(1 / first, 0) AS "MRR",
    CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, least(n_rel, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS "nDCG@10" FROM o)"""


def _arm_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every query and arm; one set-oriented job for all arms."""
    ranked = _ranked(spark, d)
    arms = ranked.select("arm").distinct()  # as many rows as configured arms
    asked = eval_queries(spark, d).crossJoin(F.broadcast(arms))
    lists = ranked.groupBy("query_id", "arm").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "song_id"))), lambda s: s["song_id"]).alias("ranked"))
    out = asked.join(lists, ["query_id", "arm"], "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    return ev.query_metrics(out)


@query(f"""WITH {_OUT} SELECT query_id, arm, {', '.join(f'round("{m}", 6) AS "{m}"' for m in METRICS)} FROM m""")
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _arm_metrics(spark, d).select("query_id", "arm", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in METRICS])


@query(f"""WITH {_OUT} SELECT arm, count(*) AS n, {', '.join(f'round(avg("{m}"), 6) AS "{m}"' for m in METRICS)} FROM m GROUP BY arm""")
def arm_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _arm_metrics(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f"`{m}`")), 6).alias(m) for m in METRICS])


_SPLIT = """cl AS (SELECT song_id, CASE WHEN min(split_by) = max(split_by) THEN min(split_by) WHEN count(split_by) > 0 THEN 'mixed' ELSE 'mixed' END || '/force_split=' || CASE WHEN bool_or(coalesce(force_split, false)) THEN 'True' ELSE 'False' END AS label FROM chunks1 GROUP BY 1),
sl AS (SELECT song_id, coalesce(label, '(unknown)') AS label FROM songs1 LEFT JOIN cl USING (song_id)),
rel1 AS (SELECT query_id, unnest(CASE WHEN len(relevant_song_ids) > 0 THEN relevant_song_ids ELSE [NULL] END) AS song_id FROM evals1),
ql AS (SELECT query_id, CASE WHEN min(v) = max(v) THEN min(v) ELSE 'mixed' END AS value FROM (SELECT query_id, coalesce(label, '(unknown)') AS v FROM rel1 LEFT JOIN sl USING (song_id)) GROUP BY 1),
tl AS (SELECT query_id, CASE WHEN min(v) = max(v) THEN min(v) ELSE 'mixed' END AS value FROM (SELECT query_id, coalesce(is_translation::VARCHAR, '(unknown)') AS v FROM rel1 LEFT JOIN songs1 USING (song_id)) GROUP BY 1)"""


@query(f"WITH {SONGS}, {CHUNKS}, {EVALS}, {_SPLIT} SELECT song_id, label AS split_label FROM sl")
def song_split_labels(spark: SparkSession, d: str) -> DataFrame:
    return ev.song_split_labels(songs(spark, d), chunks(spark, d))


@query(f"WITH {SONGS}, {CHUNKS}, {EVALS}, {_SPLIT} SELECT query_id, value FROM ql")
def query_split_labels(spark: SparkSession, d: str) -> DataFrame:
    return ev.query_labels(eval_queries(spark, d), ev.song_split_labels(songs(spark, d), chunks(spark, d)), "split_label")


def _slices(spark: SparkSession, d: str, metrics: DataFrame, **how) -> DataFrame:
    asked, all_songs = eval_queries(spark, d), songs(spark, d)
    translated = all_songs.withColumn("label", F.col("is_translation").cast("string"))
    dims = {
        "split_by": ev.query_labels(asked, ev.song_split_labels(all_songs, chunks(spark, d)), "split_label"),
        "is_translation": ev.query_labels(asked, translated, "label"),
        "query_type": ev.column_label(asked, F.col("query_type")),
        "stratum": ev.column_label(asked, F.lower(F.trim("stratum"))),
    }
    return ev.slice_table(metrics, dims, **how)


_LONG = " UNION ALL ".join(f"SELECT query_id, arm, '{m}' AS metric, \"{m}\" AS x FROM m" for m in METRICS)


@query(
    f"""WITH {_OUT}, {SONGS}, {CHUNKS}, {_SPLIT}, long AS ({_LONG}),
d AS (SELECT arm, 'overall' AS dimension, 'all' AS value, metric, x FROM long
    UNION ALL SELECT arm, 'split_by', coalesce(value, '(none)'), metric, x FROM long LEFT JOIN ql USING (query_id)
    UNION ALL SELECT arm, 'is_translation', coalesce(value, '(none)'), metric, x FROM long LEFT JOIN tl USING (query_id)
    UNION ALL SELECT arm, 'query_type', coalesce(query_type, '(none)'), metric, x FROM long LEFT JOIN evals1 USING (query_id)
    UNION ALL SELECT arm, 'stratum', coalesce(lower(trim(stratum)), '(none)'), metric, x FROM long LEFT JOIN evals1 USING (query_id))
SELECT arm, dimension, value, metric, count(*) AS n, round(avg(x), 6) AS mean FROM d GROUP BY ALL"""
)
def eval_slices(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d, _arm_metrics(spark, d), by=("arm",)).withColumn("mean", F.round("mean", 6))


@query()
def eval_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d, _arm_metrics(spark, d), intervals=True, by=("arm",))


_LEAK = rf"""qt AS (SELECT query_id, source_chunk_id, unnest(list_distinct(regexp_extract_all(lower(query), {TERMS}))) AS term FROM evals1 WHERE source_chunk_id IS NOT NULL AND query IS NOT NULL),
ct AS (SELECT DISTINCT chunk_id, term FROM cpost),
lo AS (SELECT query_id, round(coalesce(sum(CASE WHEN ct.term IS NOT NULL THEN idf END), 0), 6) AS weight_shared, round(coalesce(sum(idf), 0), 6) AS weight_total,
    round(coalesce(max(CASE WHEN ct.term IS NOT NULL THEN idf END), 0), 6) AS max_shared_idf,
    coalesce(string_agg(CASE WHEN ct.term IS NOT NULL AND idf IS NOT NULL THEN qt.term END, ' ' ORDER BY qt.term), '') AS shared,
    coalesce(string_agg(CASE WHEN idf IS NULL THEN qt.term END, ' ' ORDER BY qt.term), '') AS unknown,
    CASE WHEN coalesce(sum(idf), 0) > 0 THEN round(coalesce(sum(CASE WHEN ct.term IS NOT NULL THEN idf END), 0) / sum(idf), 6) ELSE 0 END AS ratio
    FROM qt LEFT JOIN cidf ON cidf.term = qt.term LEFT JOIN ct ON ct.chunk_id = source_chunk_id AND ct.term = qt.term GROUP BY 1),
leak AS (SELECT e.query_id, coalesce(weight_shared, 0) AS weight_shared, coalesce(weight_total, 0) AS weight_total, coalesce(max_shared_idf, 0) AS max_shared_idf, coalesce(shared, '') AS shared, coalesce(unknown, '') AS unknown, coalesce(ratio, 0) AS ratio
    FROM evals1 e LEFT JOIN lo USING (query_id) WHERE source_chunk_id IS NOT NULL AND query IS NOT NULL)"""


def _leaks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    corpus = chunks(spark, d)
    model = inv.fit_tfidf(corpus, "chunk_id", tx.tfidf_terms(F.col("text")))
    asked = eval_queries(spark, d).where("source_chunk_id is not null and query is not null")
    pairs = asked.join(corpus.select(F.col("chunk_id").alias("source_chunk_id"), "text"), "source_chunk_id", "left")
    scores = leak.weighted_overlap(pairs, ["query_id"], tx.tfidf_terms(F.col("query")), tx.tfidf_terms(F.col("text")), model.idf)
    return scores, model.totals


_LEAK_COLS = "query_id, weight_shared, weight_total, max_shared_idf, shared, unknown, ratio"


@query(f"WITH {CHUNKS}, {EVALS}, {TFIDF}, {_LEAK} SELECT {_LEAK_COLS} FROM leak")
def leak_scores_now(spark: SparkSession, d: str) -> DataFrame:
    s = _leaks(spark, d)[0]
    numbers = [F.round(c, 6).alias(c) for c in ("weight_shared", "weight_total", "max_shared_idf", "ratio")]
    return s.select("query_id", *numbers, F.array_join("shared", " ").alias("shared"), F.array_join("unknown", " ").alias("unknown"))


@query(f"WITH {CHUNKS}, {EVALS}, {TFIDF}, {_LEAK} SELECT query_id, max_shared_idf < round(ln((1 + n_docs) / 101) + 1, 6) AS passes FROM leak, nd")
def leak_gate(spark: SparkSession, d: str) -> DataFrame:
    s, totals = _leaks(spark, d)
    limit = F.round(inv.smooth_idf(F.col("n_docs"), F.lit(leak.MAX_DF)), 6)
    return s.crossJoin(F.broadcast(totals)).select("query_id", (F.round("max_shared_idf", 6) < limit).alias("passes"))


@query(f"WITH {CHUNKS}, {TFIDF} SELECT term, df, round((1 + n_docs) / exp(idf - 1) - 1, 4) AS df_again FROM cidf, nd")
def idf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    model = inv.fit_tfidf(chunks(spark, d), "chunk_id", tx.tfidf_terms(F.col("text")))
    return model.idf.crossJoin(F.broadcast(model.totals)).select("term", "df", F.round(inv.df_of_smooth_idf(F.col("n_docs"), F.col("idf")), 4).alias("df_again"))


@query(
    rf"""WITH {CHUNKS}, {EVALS}, {SONGS}, {TFIDF}, q AS (SELECT query_id, unnest(relevant_song_ids) AS song_id, list_distinct(regexp_extract_all(lower(query), {TERMS})) AS qt FROM evals1 WHERE query IS NOT NULL),
mt AS (SELECT query_id, unnest(list_intersect(qt, regexp_extract_all(lower(coalesce(artist, '') || ' ' || coalesce(title, '')), {TERMS}))) AS term FROM q JOIN songs1 USING (song_id))
SELECT query_id, round(max(idf), 6) AS meta_max_idf FROM mt JOIN cidf USING (term) GROUP BY 1"""
)
def title_control(spark: SparkSession, d: str) -> DataFrame:
    model = inv.fit_tfidf(chunks(spark, d), "chunk_id", tx.tfidf_terms(F.col("text")))
    asked = eval_queries(spark, d).where("query is not null").select("query_id", "query", F.explode("relevant_song_ids").alias("song_id"))
    meta = F.concat_ws(" ", F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit("")))
    pairs = asked.join(songs(spark, d).select("song_id", meta.alias("meta")), "song_id")
    shared = pairs.select("query_id", F.explode(F.array_intersect(tx.tfidf_terms(F.col("query")), tx.tfidf_terms(F.col("meta")))).alias("term"))
    return shared.join(model.idf, "term").groupBy("query_id").agg(F.round(F.max("idf"), 6).alias("meta_max_idf"))


_ATTEMPTS = """att AS (SELECT query_id, attempt, passes FROM (SELECT *, row_number() OVER (PARTITION BY query_id, attempt ORDER BY scored_at DESC NULLS LAST, passes DESC NULLS LAST) AS rn FROM leak_scores WHERE attempt IS NOT NULL) WHERE rn = 1)"""


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "leak_scores").where("attempt is not null")
    return a.groupBy("query_id", "attempt").agg(F.max(F.struct("scored_at", "passes")).alias("m")).select("query_id", "attempt", "m.passes")


@query(
    f"""WITH {_ATTEMPTS}, k AS (SELECT query_id, min(CASE WHEN passes THEN attempt END) AS first_pass, max(attempt) AS n_attempts FROM att GROUP BY 1)
SELECT *, CASE WHEN first_pass IS NOT NULL THEN 'passed' WHEN n_attempts >= 3 THEN 'exhausted' ELSE 'pending' END AS state FROM k"""
)
def attrition(spark: SparkSession, d: str) -> DataFrame:
    return leak.attrition(_attempts(spark, d), ["query_id"])


@query(f"WITH {_ATTEMPTS} SELECT attempt, count(*) AS n, sum((NOT passes)::INT)::BIGINT AS n_failed, round(sum((NOT passes)::INT) / count(*), 6) AS fail_rate FROM att WHERE passes IS NOT NULL GROUP BY 1")
def failure_by_attempt(spark: SparkSession, d: str) -> DataFrame:
    return leak.failure_by_attempt(_attempts(spark, d)).withColumn("fail_rate", F.round("fail_rate", 6))


@query(
    rf"""WITH {CHUNKS}, {EVALS} SELECT query_id, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) ELSE 0 END AS jaccard
FROM (SELECT query_id, list_distinct(regexp_extract_all(lower(query), {TERMS})) AS a, list_distinct(regexp_extract_all(lower(text), {TERMS})) AS b FROM evals1 JOIN chunks1 ON chunk_id = source_chunk_id WHERE query IS NOT NULL AND text IS NOT NULL)"""
)
def query_source_jaccard(spark: SparkSession, d: str) -> DataFrame:
    pairs = eval_queries(spark, d).where("query is not null").join(chunks(spark, d).where("text is not null").select(F.col("chunk_id").alias("source_chunk_id"), "text"), "source_chunk_id")
    return pairs.select("query_id", F.round(leak.jaccard(tx.tfidf_terms(F.col("query")), tx.tfidf_terms(F.col("text"))), 6).alias("jaccard"))


@query(
    rf"""WITH {CHUNKS}, {EVALS}, {TFIDF}, fr AS (SELECT chunk_id, floor((row_number() OVER (ORDER BY chunk_id) - 1) / 25) AS group_no FROM (SELECT DISTINCT source_chunk_id AS chunk_id FROM evals1 WHERE source_chunk_id IS NOT NULL)),
ft AS (SELECT DISTINCT chunk_id, group_no, term FROM fr JOIN cpost USING (chunk_id)),
qt AS (SELECT query_id, source_chunk_id AS own, group_no, unnest(list_distinct(regexp_extract_all(lower(query), {TERMS}))) AS term FROM evals1 JOIN fr ON chunk_id = source_chunk_id),
me AS (SELECT query_id, ft.chunk_id, qt.term, round(idf, 6) AS idf, max(round(idf, 6)) OVER (PARTITION BY query_id, ft.chunk_id) AS top FROM qt JOIN ft ON ft.group_no = qt.group_no AND ft.term = qt.term AND ft.chunk_id <> own JOIN cidf ON cidf.term = qt.term),
pr AS (SELECT query_id, chunk_id, top AS idf, string_agg(term, ' ' ORDER BY term) FILTER (idf >= top) AS terms FROM me GROUP BY ALL)
SELECT query_id, chunk_id AS other_fragment, idf AS max_other_idf, terms AS cross_terms FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, chunk_id) AS rn FROM pr) WHERE rn = 1"""
)
def contamination(spark: SparkSession, d: str) -> DataFrame:
    corpus, asked = chunks(spark, d), eval_queries(spark, d)
    model = inv.fit_tfidf(corpus, "chunk_id", tx.tfidf_terms(F.col("text")))
    used = asked.where("source_chunk_id is not null").select(F.col("source_chunk_id").alias("chunk_id")).distinct()
    groups = pooling.grouped(used, "chunk_id", 25)
    fragments = groups.join(corpus, "chunk_id").select(F.col("chunk_id").alias("fragment_id"), "group_no", tx.tfidf_terms(F.col("text")).alias("terms"))
    q = asked.join(groups.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id").withColumnRenamed("source_chunk_id", "fragment_id")
    return leak.contamination(fragments, q, model.idf, tx.tfidf_terms(F.col("query"))).withColumn("cross_terms", F.array_join("cross_terms", " "))


# replies made of the evaluation queries: an attempt and a type by the query's id
_REPLIES = f"""re AS (SELECT source_chunk_id AS chunk_id, 1 + query_id % 3 AS attempt, min(CASE WHEN query_id % 2 = 0 THEN query END) AS paraphrase, min(CASE WHEN query_id % 2 = 1 THEN query END) AS description
    FROM evals1 WHERE source_chunk_id IS NOT NULL GROUP BY ALL),
tries AS (SELECT chunk_id, attempt, 'paraphrase' AS query_type, paraphrase AS text FROM re WHERE paraphrase IS NOT NULL UNION ALL SELECT chunk_id, attempt, 'description', description FROM re WHERE description IS NOT NULL),
fr AS (SELECT chunk_id, song_id, split_by AS stratum, text AS source, lower(concat_ws(' ', title, artist)) AS meta FROM chunks1 LEFT JOIN songs1 USING (song_id)),
tt AS (SELECT chunk_id, query_type, attempt, unnest(list_distinct(regexp_extract_all(lower(text), {TERMS}))) AS term FROM tries),
inq AS (SELECT tt.*, idf, list_contains(regexp_extract_all(lower(coalesce(source, '')), {TERMS}), tt.term) AS own, list_contains(regexp_extract_all(coalesce(meta, ''), {TERMS}), tt.term) AS control
    FROM tt LEFT JOIN fr USING (chunk_id) LEFT JOIN cidf ON cidf.term = tt.term),
sc AS (SELECT chunk_id, query_type, attempt, coalesce(sum(CASE WHEN own THEN idf END), 0) / nullif(sum(idf), 0) AS ratio, max(CASE WHEN own THEN idf END) AS top, max(CASE WHEN control THEN idf END) AS meta FROM inq GROUP BY ALL),
gated AS (SELECT tries.*, song_id, stratum, {words_sql("tries.text")} AS n_words, coalesce(ratio, 0) AS ratio, coalesce(top, 0) AS max_shared_idf, coalesce(sc.meta, 0) AS meta_max_idf,
    round(coalesce(top, 0), 6) < round(ln((1 + n_docs) / 101) + 1, 6) AS passes, round(coalesce(sc.meta, 0), 6) >= round(ln((1 + n_docs) / 101) + 1, 6) AS title_leak
    FROM tries LEFT JOIN fr USING (chunk_id) LEFT JOIN sc USING (chunk_id, query_type, attempt), nd),
keys AS (SELECT chunk_id, query_type, min(stratum) AS stratum, min(CASE WHEN passes THEN attempt END) AS first_pass, max(attempt) AS n_attempts FROM gated GROUP BY 1, 2),
states AS (SELECT *, CASE WHEN first_pass IS NOT NULL THEN 'passed' WHEN n_attempts >= 3 THEN 'exhausted' ELSE 'pending' END AS state FROM keys)"""
_GATED = f"WITH {CHUNKS}, {EVALS}, {SONGS}, {TFIDF}, {_REPLIES}"


def _gated(spark: SparkSession, d: str) -> DataFrame:
    corpus, n = chunks(spark, d), F.col("query_id")
    model = inv.fit_tfidf(corpus, "chunk_id", tx.tfidf_terms(F.col("text")))
    asked = eval_queries(spark, d).where("source_chunk_id is not null").groupBy(F.col("source_chunk_id").alias("chunk_id"), (1 + n % 3).alias("attempt"))
    replies = asked.agg(F.min(F.when(n % 2 == 0, F.col("query"))).alias("paraphrase"), F.min(F.when(n % 2 == 1, F.col("query"))).alias("description"))
    fragments = corpus.select("chunk_id", "song_id", F.col("split_by").alias("stratum"), "text")
    return gate.score_attempts(gate.long_replies(replies), fragments, songs(spark, d), model.idf, model.totals.first().n_docs)


@query(f"{_GATED} SELECT chunk_id, query_type, attempt, song_id, n_words, round(ratio, 6) AS ratio, round(max_shared_idf, 6) AS max_shared_idf, round(meta_max_idf, 6) AS meta_max_idf, passes, title_leak FROM gated")
def gate_attempts(spark: SparkSession, d: str) -> DataFrame:
    numbers = [F.round(c, 6).alias(c) for c in ("ratio", "max_shared_idf", "meta_max_idf")]
    return _gated(spark, d).select("chunk_id", "query_type", "attempt", "song_id", F.col("n_words").cast("bigint").alias("n_words"), *numbers, "passes", "title_leak")


@query(f"{_GATED} SELECT g.chunk_id, g.query_type, text AS query, song_id, g.stratum, attempt FROM gated g JOIN keys k ON k.chunk_id = g.chunk_id AND k.query_type = g.query_type AND g.attempt = first_pass")
def gate_accepted(spark: SparkSession, d: str) -> DataFrame:
    return gate.accepted(_gated(spark, d)).withColumn("song_id", F.col("relevant_song_ids")[0]).drop("relevant_song_ids")


@query(f"{_GATED} SELECT DISTINCT chunk_id FROM states WHERE state = 'pending'")
def gate_retries(spark: SparkSession, d: str) -> DataFrame:
    return gate.retries(_gated(spark, d))


@query(
    f"""{_GATED} SELECT query_type, stratum, count(*) AS n, count(*) FILTER (state = 'passed') AS passed, count(*) FILTER (state = 'exhausted') AS exhausted, count(*) FILTER (state = 'pending') AS pending,
    count(*) FILTER (n_attempts > 1) AS n_retried, count(*) FILTER (n_attempts > 1 AND state <> 'passed') AS n_failed_again,
    round(count(*) FILTER (n_attempts > 1 AND state <> 'passed') / nullif(count(*) FILTER (n_attempts > 1), 0), 6) AS repeat_fail_rate FROM states GROUP BY 1, 2"""
)
def gate_attrition(spark: SparkSession, d: str) -> DataFrame:
    return gate.attrition_report(_gated(spark, d)).withColumn("repeat_fail_rate", F.round("repeat_fail_rate", 6))


@query(
    f"""{_GATED}, ok AS (SELECT g.text FROM gated g JOIN keys k ON k.chunk_id = g.chunk_id AND k.query_type = g.query_type AND g.attempt = first_pass)
SELECT (SELECT count(*) FROM ok) AS n_accepted, (SELECT count(*) FROM (SELECT text FROM ok GROUP BY 1 HAVING count(*) > 1)) AS n_duplicate_texts,
    count(*) FILTER (state = 'exhausted' AND query_type = 'paraphrase') AS n_lost_paraphrase, count(DISTINCT chunk_id) FILTER (state = 'pending') AS n_retry FROM states"""
)
def gate_totals(spark: SparkSession, d: str) -> DataFrame:
    return gate.attrition_totals(_gated(spark, d))


@query(
    f"""{_GATED} SELECT query_type, count(*) AS n, round(avg(n_words), 6) AS mean_words, min(n_words) AS min_words, max(n_words) AS max_words, round(avg(ratio), 6) AS mean_ratio, round(max(ratio), 6) AS max_ratio,
    round(max(max_shared_idf), 6) AS worst_idf, count(*) FILTER (NOT passes) AS n_failed, count(*) FILTER (title_leak) AS n_title_leaks FROM gated WHERE attempt = 1 GROUP BY 1"""
)
def gate_first_attempts(spark: SparkSession, d: str) -> DataFrame:
    r = gate.first_attempts(_gated(spark, d))
    whole = [F.col(c).cast("bigint").alias(c) for c in ("min_words", "max_words")]
    return r.select("query_type", "n", *whole, *[F.round(c, 6).alias(c) for c in ("mean_words", "mean_ratio", "max_ratio", "worst_idf")], "n_failed", "n_title_leaks")


# two arms of replies to each asked chunk: the query first, or the chunk's own beginning first
_ARMS = f"""src AS (SELECT source_chunk_id AS chunk_id, min(query) AS q FROM evals1 WHERE source_chunk_id IS NOT NULL AND query IS NOT NULL GROUP BY 1),
re AS (SELECT 'query_first' AS arm, chunk_id, q AS paraphrase, substr(text, 1, 60) AS description FROM src JOIN chunks1 USING (chunk_id)
    UNION ALL SELECT 'text_first', chunk_id, substr(text, 1, 60), q FROM src JOIN chunks1 USING (chunk_id) WHERE text IS NOT NULL),
co AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS rn FROM (SELECT chunk_id FROM re GROUP BY 1 HAVING count(DISTINCT arm) = 2)),
ar AS (SELECT arm, chunk_id, rn // 25 AS group_no, rn % 25 AS place, 'paraphrase' AS query_type, paraphrase AS text FROM re JOIN co USING (chunk_id) WHERE paraphrase IS NOT NULL
    UNION ALL SELECT arm, chunk_id, rn // 25, rn % 25, 'description', description FROM re JOIN co USING (chunk_id) WHERE description IS NOT NULL),
tt AS (SELECT arm, chunk_id, query_type, group_no, unnest(list_distinct(regexp_extract_all(lower(text), {TERMS}))) AS term FROM ar),
ft AS (SELECT DISTINCT chunk_id, rn // 25 AS group_no, term FROM co JOIN cpost USING (chunk_id)),
own AS (SELECT tt.arm, tt.chunk_id, tt.query_type, coalesce(sum(CASE WHEN ft.term IS NOT NULL THEN idf END), 0) / nullif(sum(idf), 0) AS ratio, max(CASE WHEN ft.term IS NOT NULL THEN idf END) AS top
    FROM tt LEFT JOIN cidf ON cidf.term = tt.term LEFT JOIN ft ON ft.chunk_id = tt.chunk_id AND ft.term = tt.term GROUP BY ALL),
cross_ AS (SELECT tt.arm, tt.chunk_id, tt.query_type, max(round(idf, 6)) AS other FROM tt JOIN ft ON ft.group_no = tt.group_no AND ft.term = tt.term AND ft.chunk_id <> tt.chunk_id JOIN cidf ON cidf.term = tt.term GROUP BY ALL),
ro AS (SELECT ar.*, {words_sql("text")} AS n_words, coalesce(ratio, 0) AS ratio, coalesce(top, 0) AS own_idf, coalesce(other, 0) AS cross_idf, round(ln((1 + n_docs) / 101) + 1, 6) AS gate
    FROM ar LEFT JOIN own USING (arm, chunk_id, query_type) LEFT JOIN cross_ USING (arm, chunk_id, query_type), nd)"""
_ARMED = f"WITH {CHUNKS}, {EVALS}, {TFIDF}, {_ARMS}"


def _arm_reports(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    corpus = chunks(spark, d)
    model = inv.fit_tfidf(corpus, "chunk_id", tx.tfidf_terms(F.col("text")))
    asked = eval_queries(spark, d).where("source_chunk_id is not null and query is not null").groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.min("query").alias("q"))
    both = asked.join(corpus.select("chunk_id", F.substring("text", 1, 60).alias("t")), "chunk_id")
    one = both.select(F.lit("query_first").alias("arm"), "chunk_id", F.lit(1).alias("attempt"), F.col("q").alias("paraphrase"), F.col("t").alias("description"))
    other = both.where("t is not null").select(F.lit("text_first").alias("arm"), "chunk_id", F.lit(1).alias("attempt"), F.col("t").alias("paraphrase"), F.col("q").alias("description"))
    return gate.arm_reports(gate.arm_rows(one.unionByName(other), corpus, model.idf, model.totals.first().n_docs))


@query(f"{_ARMED} SELECT arm, query_type, count(*) AS n, round(avg(cross_idf), 9) AS mean_idf, round(max(cross_idf), 6) AS worst_idf, count(*) FILTER (cross_idf >= gate) AS n_over FROM ro GROUP BY 1, 2")
def arm_cross_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _arm_reports(spark, d)["cross"].withColumns({"mean_idf": F.round("mean_idf", 9), "worst_idf": F.round("worst_idf", 6)})


@query(f"{_ARMED} SELECT arm, query_type, round(avg(ratio), 6) AS mean_ratio, round(avg(own_idf), 6) AS mean_idf, round(max(own_idf), 6) AS worst_idf FROM ro GROUP BY 1, 2")
def arm_own_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _arm_reports(spark, d)["own"].withColumns({c: F.round(c, 6) for c in ("mean_ratio", "mean_idf", "worst_idf")})


@query(f"{_ARMED} SELECT arm, query_type, count(*) AS n, count(*) FILTER (round(own_idf, 6) >= gate) AS n_failed FROM ro GROUP BY 1, 2")
def arm_failures(spark: SparkSession, d: str) -> DataFrame:
    return _arm_reports(spark, d)["failures"]


@query(f"{_ARMED} SELECT arm, place, count(*) AS n, count(*) FILTER (round(own_idf, 6) >= gate) AS n_failed, round(avg(cross_idf), 9) AS mean_idf FROM ro GROUP BY 1, 2")
def arm_places(spark: SparkSession, d: str) -> DataFrame:
    return _arm_reports(spark, d)["places"].withColumn("mean_idf", F.round("mean_idf", 9))


@query(
    f"""{_ARMED}, j AS (SELECT arm, list_distinct(regexp_extract_all(lower(paraphrase), {TERMS})) AS a, list_distinct(regexp_extract_all(lower(description), {TERMS})) AS b FROM re JOIN co USING (chunk_id) WHERE paraphrase IS NOT NULL AND description IS NOT NULL),
x AS (SELECT arm, round(avg(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END), 6) AS pair_jaccard FROM j GROUP BY 1)
SELECT arm, round(avg(n_words) FILTER (query_type = 'paraphrase'), 6) AS paraphrase_words, round(avg(n_words) FILTER (query_type = 'description'), 6) AS description_words, any_value(pair_jaccard) AS pair_jaccard FROM ro LEFT JOIN x USING (arm) GROUP BY 1"""
)
def arm_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _arm_reports(spark, d)["lengths"].withColumns({c: F.round(c, 6) for c in ("paraphrase_words", "description_words", "pair_jaccard")})


@query(
    f"""WITH {SONGS}, {CHUNKS}, p AS (SELECT song_id, chunk_id, position, row_number() OVER (PARTITION BY song_id ORDER BY md5(chunk_id || ':7'), chunk_id) AS rn FROM chunks1 WHERE length(text) >= 80),
s AS (SELECT song_id, is_translation, position, CASE WHEN p.song_id IS NULL THEN 'no_fragment' END AS skipped FROM songs1 LEFT JOIN (SELECT * FROM p WHERE rn = 1) p USING (song_id))
SELECT 'is_translation' AS what, coalesce(is_translation::VARCHAR, '(none)') AS value, count(*) AS n FROM s WHERE skipped IS NULL GROUP BY 2
UNION ALL SELECT 'position', '0', count(*) FROM s WHERE skipped IS NULL AND position = 0 HAVING count(*) > 0 UNION ALL SELECT 'skipped', skipped, count(*) FROM s WHERE skipped IS NOT NULL GROUP BY 2"""
)
def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    drawn = pooling.fragment_per_song(songs(spark, d), chunks(spark, d), 7).select("song_id", "chunk_id", "skipped")
    known = songs(spark, d).select("song_id", "is_translation")
    return gate.sample_counts(drawn.join(known, "song_id").join(chunks(spark, d).select("chunk_id", "position"), "chunk_id", "left"))


@query(f"WITH {HITS} SELECT song_id FROM hits1 GROUP BY 1 HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM hits1)")
def songs_in_all_arms(spark: SparkSession, d: str) -> DataFrame:
    return leak.in_all_arms(hits(spark, d), "arm", "song_id")


_POOLS = f"""{SONGS}, {CHUNKS}, st AS (SELECT song_id FROM chunks1 GROUP BY 1 HAVING min(split_by) = max(split_by) AND count(*) = count(split_by) AND min(split_by) IN ('none', 'plain_label')),
tr AS (SELECT song_id FROM songs1 WHERE is_translation),
a AS (SELECT 'structure' AS stratum, song_id FROM st ORDER BY md5('structure:' || song_id || ':20260811'), song_id LIMIT 10),
b AS (SELECT 'translation' AS stratum, song_id FROM tr WHERE song_id NOT IN (SELECT song_id FROM a) ORDER BY md5('translation:' || song_id || ':20260811'), song_id LIMIT 5),
c AS (SELECT 'main' AS stratum, song_id FROM (SELECT DISTINCT song_id FROM chunks1) WHERE song_id NOT IN (SELECT song_id FROM a UNION ALL SELECT song_id FROM b) ORDER BY md5('main:' || song_id || ':20260811'), song_id LIMIT 50)"""


@query(f"WITH {_POOLS} SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    corpus = chunks(spark, d)
    pools = [("structure", pooling.structural_songs(corpus), 10), ("translation", songs(spark, d).where("is_translation"), 5), ("main", corpus, 50)]
    return pooling.stratified_sample(pools, "song_id", 20260811)


@query(f"""WITH {SONGS}, {CHUNKS}, p AS (SELECT song_id, chunk_id, row_number() OVER (PARTITION BY song_id ORDER BY md5(chunk_id || ':7'), chunk_id) AS rn FROM chunks1 WHERE length(text) >= 80)
SELECT song_id, chunk_id, CASE WHEN chunk_id IS NULL THEN 'no_fragment' END AS skipped FROM songs1 LEFT JOIN (SELECT * FROM p WHERE rn = 1) USING (song_id)""")
def fragments(spark: SparkSession, d: str) -> DataFrame:
    return pooling.fragment_per_song(songs(spark, d), chunks(spark, d), 7).select("song_id", "chunk_id", "skipped")


@query(f"WITH {EVALS} SELECT query_id, query FROM evals1 ORDER BY query_id LIMIT 25 OFFSET 25")
def batch_slice(spark: SparkSession, d: str) -> DataFrame:
    return pooling.batch_slice(eval_queries(spark, d).select("query_id", "query"), [F.asc("query_id")], 1, 25)


@query(f"WITH {EVALS} SELECT query_id, floor((rn - 1) / 25)::BIGINT AS group_no, ((rn - 1) % 25)::BIGINT AS place FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) AS rn FROM evals1)")
def query_groups(spark: SparkSession, d: str) -> DataFrame:
    return pooling.grouped(eval_queries(spark, d).select("query_id"), "query_id", 25)


@query(f"WITH {EVALS} SELECT query_id FROM evals1 WHERE query_id NOT IN (SELECT query_id FROM leak_scores WHERE attempt = 1)")
def missing_replies(spark: SparkSession, d: str) -> DataFrame:
    return pooling.missing_replies(eval_queries(spark, d), table(spark, d, "leak_scores").where("attempt = 1"), "query_id")


_POOL = f"WITH {_RANKED}, pool AS (SELECT query_id, song_id, min(rank) AS best_rank, count(*) AS n_arms, string_agg(arm || '#' || rank, ',' ORDER BY arm) AS found_by FROM turned WHERE rank <= 5 GROUP BY ALL)"


@query(f"{_POOL} SELECT * FROM pool")
def judgement_pool(spark: SparkSession, d: str) -> DataFrame:
    return pooling.pool(_ranked(spark, d)).withColumn("found_by", F.array_join(F.transform("found_by", lambda x: F.concat_ws("#", x["arm"], x["rank"])), ","))


@query(f"{_POOL} SELECT min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean, count(*) AS n_pools FROM (SELECT count(*) AS n FROM pool GROUP BY query_id)")
def pool_sizes(spark: SparkSession, d: str) -> DataFrame:
    return pooling.pool_sizes(pooling.pool(_ranked(spark, d))).withColumn("mean", F.round("mean", 6))


@query(f"""{_POOL} SELECT query_id, song_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id <= 4 THEN lpad(best_rank::VARCHAR, 12, '0') || song_id ELSE md5(query_id || '‖' || song_id || '‖' || '0') END, song_id) AS shown_at FROM pool""")
def display_order(spark: SparkSession, d: str) -> DataFrame:
    return pooling.display_order(pooling.pool(_ranked(spark, d)), F.col("query_id") <= 4, 0).select("query_id", "song_id", "shown_at")


# judgements and themes made of the tables' own rows
_JUDGED = "judged AS (SELECT query_id, song_id, CASE WHEN query_id % 7 = 0 THEN NULL ELSE (query_id % 3)::INT END AS grade, query_id % 7 = 0 AS dont_know FROM pool WHERE query_id % 2 = 0)"


def _judged(pooled: DataFrame) -> DataFrame:
    n = F.col("query_id")
    return pooled.where(n % 2 == 0).select("query_id", "song_id", F.when(n % 7 != 0, (n % 3).cast("int")).alias("grade"), (n % 7 == 0).alias("dont_know"))


@query(f"{_POOL}, {_JUDGED} SELECT query_id, song_id, best_rank FROM pool p WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.query_id = p.query_id AND j.song_id = p.song_id)")
def pending_judgements(spark: SparkSession, d: str) -> DataFrame:
    p = pooling.pool(_ranked(spark, d))
    return pooling.pending(p, _judged(p)).select("query_id", "song_id", "best_rank")


@query(f"{_POOL}, {_JUDGED} SELECT CASE WHEN dont_know THEN 'dont_know' ELSE coalesce(grade::VARCHAR, '(none)') END AS grade, count(*) AS n FROM judged GROUP BY 1")
def judgement_counts(spark: SparkSession, d: str) -> DataFrame:
    return pooling.judgement_counts(_judged(pooling.pool(_ranked(spark, d))))


_THEMES = f"""{EVALS}, themes AS (SELECT query_id AS theme_id, query AS text, CASE WHEN length(query) < 40 THEN 'short' WHEN length(query) < 60 THEN 'medium' ELSE 'expanded' END AS tier,
    CASE query_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unsure' END AS mark, CASE query_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS keep,
    CASE WHEN query_id % 5 < 3 THEN query_id END AS mark_seq, NULL::BOOLEAN AS recheck, NULL::VARCHAR AS mark_before_recheck FROM evals1 WHERE query IS NOT NULL)"""


def _themes(spark: SparkSession, d: str) -> DataFrame:
    n, length = F.col("query_id") % 5, F.length("query")
    mark = F.when(n == 0, "yes").when(n == 1, "no").when(n == 2, "unsure")
    q = eval_queries(spark, d).where("query is not null").withColumn("mark", mark)
    return q.select(
        F.col("query_id").alias("theme_id"), F.col("query").alias("text"),
        F.when(length < 40, "short").when(length < 60, "medium").otherwise("expanded").alias("tier"),
        "mark", pooling.keep_of_mark(F.col("mark")).alias("keep"), F.when(n < 3, F.col("query_id")).alias("mark_seq"),
        F.lit(None).cast("boolean").alias("recheck"), F.lit(None).cast("string").alias("mark_before_recheck"),
    )


@query(f"WITH {_THEMES} SELECT theme_id, tier FROM themes WHERE keep IS DISTINCT FROM false AND mark IS DISTINCT FROM 'unsure'")
def usable_themes(spark: SparkSession, d: str) -> DataFrame:
    return pooling.usable_themes(_themes(spark, d)).select("theme_id", "tier")


@query(f"WITH {_THEMES} SELECT theme_id, mark, CASE WHEN mark = 'unsure' THEN true ELSE recheck END AS recheck, CASE WHEN mark = 'unsure' THEN mark ELSE mark_before_recheck END AS mark_before_recheck FROM themes")
def recheck_queue(spark: SparkSession, d: str) -> DataFrame:
    return pooling.stamp_recheck(_themes(spark, d)).select("theme_id", "mark", "recheck", "mark_before_recheck")


@query(f"WITH {_THEMES} SELECT tier, sum((keep IS NOT DISTINCT FROM true)::INT)::BIGINT AS n_kept, count(*) AS n_themes FROM themes GROUP BY 1")
def tier_tally(spark: SparkSession, d: str) -> DataFrame:
    return pooling.tier_tally(_themes(spark, d))


@query(f"WITH {_THEMES} SELECT count(*) FILTER (keep) AS n_kept, round(count(*) FILTER (keep) * 23.5)::BIGINT AS n_judgements FROM themes")
def implied_judgements(spark: SparkSession, d: str) -> DataFrame:
    return pooling.implied_judgements(_themes(spark, d))


@query(f"WITH {EVALS} SELECT query_id, query FROM evals1 WHERE stratum = 'main'")
def stratum_queries(spark: SparkSession, d: str) -> DataFrame:
    return ev.select_stratum(eval_queries(spark, d), "main").select("query_id", "query")


@query(f"WITH {_THEMES} SELECT theme_id, CASE WHEN mark_seq = (SELECT max(mark_seq) FROM themes) THEN NULL ELSE mark END AS mark, CASE WHEN mark_seq = (SELECT max(mark_seq) FROM themes) THEN NULL ELSE mark_seq END AS mark_seq FROM themes")
def undone_mark(spark: SparkSession, d: str) -> DataFrame:
    return pooling.undo_last(_themes(spark, d)).select("theme_id", "mark", "mark_seq")


@query(f"WITH {_THEMES} SELECT theme_id FROM themes WHERE mark IS NULL")
def new_themes(spark: SparkSession, d: str) -> DataFrame:
    return pooling.select_themes(_themes(spark, d), "new").select("theme_id")


@query(f"WITH {SONGS} SELECT song_id, title FROM songs1 ORDER BY md5(song_id || ':3'), song_id LIMIT 5")
def random_examples(spark: SparkSession, d: str) -> DataFrame:
    return pooling.first_examples(songs(spark, d).select("song_id", "title"), [ingest.seeded_order(F.col("song_id"), 3), F.asc("song_id")])
