"""Registration of named queries with their SQL, and the views both sides start from.

Repeated rows of a key count once: on either side a table is first reduced to
one row per key by the same stated order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Some searches take every query whose id is divisible by this, against all rows; the others take all queries.
EVERY = 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; without SQL it is checked by tests only."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def songs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_songs(table(spark, d, "songs"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("position", "text", "section", "split_by", "force_split")]
    return ingest.first_per_key(table(spark, d, "chunks"), "chunk_id", order)


def eval_queries(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("query", "query_type", "stratum", "source_chunk_id")]
    return ingest.first_per_key(table(spark, d, "eval_queries"), "query_id", order)


def searches(spark: SparkSession, d: str) -> DataFrame:
    return eval_queries(spark, d).where(F.col("query_id") % EVERY == 0)


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Latest usable score of each query, arm and song."""
    usable = F.when(~F.isnan("score"), F.col("score"))
    latest = table(spark, d, "hits").groupBy("query_id", "arm", "song_id").agg(F.max(F.struct("scored_at", usable.alias("score"))).alias("m"))
    return latest.select("query_id", "arm", "song_id", F.col("m.score").alias("score")).where("score is not null")


def _first(table_: str, key: str, order: str) -> str:
    by = ", ".join(f"{c} NULLS FIRST" for c in order.split())
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn FROM {table_}) WHERE rn = 1)"


SONGS = "songs1 AS " + _first("songs", "song_id", "ingested_at source")
CHUNKS = "chunks1 AS " + _first("chunks", "chunk_id", "position text section split_by force_split")
EVALS = "evals1 AS " + _first("eval_queries", "query_id", "query query_type stratum source_chunk_id")
ALL_SEARCHES = EVALS + ", searches AS (SELECT * FROM evals1)"
SEARCHES = EVALS + f", searches AS (SELECT * FROM evals1 WHERE query_id % {EVERY} = 0)"
HITS = """hits1 AS (SELECT query_id, arm, song_id, score FROM (
    SELECT query_id, arm, song_id, CASE WHEN NOT isnan(score) THEN score END AS score,
           row_number() OVER (PARTITION BY query_id, arm, song_id ORDER BY scored_at DESC NULLS LAST, CASE WHEN NOT isnan(score) THEN score END DESC NULLS LAST) AS rn
    FROM hits) WHERE rn = 1 AND score IS NOT NULL)"""

#: White space in RE2, as a class.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words_sql(x: str) -> str:
    """Number of parts between white space."""
    return f"len(regexp_extract_all({x}, '[^{WS[1:]}+'))"


def dedupe_sql(x: str) -> str:
    return collapse_sql(rf"regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


def id_sql(x: str) -> str:
    return collapse_sql(f"lower(strip_accents({x}))")


TOKENS = "'[A-Za-z'']+'"
TERMS = r"'[\p{L}\p{N}_]{2,}'"

BM25 = f"""tok AS (SELECT song_id, lower(unnest(regexp_extract_all(coalesce(text_raw, ''), {TOKENS}))) AS term FROM songs1),
post AS (SELECT song_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT s.song_id, count(t.term) AS dl FROM songs1 s LEFT JOIN tok t USING (song_id) GROUP BY 1),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY term),
mi AS (SELECT avg(r) AS mean_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean_idf ELSE r END AS idf FROM raw, mi),
bag AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, lower(unnest(regexp_extract_all(query, {TOKENS}))) AS term FROM searches) GROUP BY ALL),
lex_scores AS (SELECT query_id, song_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM bag JOIN idf USING (term) JOIN post USING (term) JOIN len USING (song_id), st GROUP BY ALL),
lex_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM lex_scores WHERE score > 0) WHERE rank <= 50)"""

BEST_CHUNK = f"""held AS (SELECT DISTINCT chunk_id, lower(unnest(regexp_extract_all(text, {TOKENS}))) AS term FROM chunks1),
gains AS (SELECT t.query_id, t.song_id, c.chunk_id, any_value(c.position) AS position, round(coalesce(sum(b.qtf * i.idf), 0), 6) AS gain
    FROM lex_top t JOIN chunks1 c USING (song_id) LEFT JOIN held h USING (chunk_id)
    LEFT JOIN bag b ON b.query_id = t.query_id AND b.term = h.term LEFT JOIN idf i ON i.term = b.term GROUP BY ALL),
chosen AS (SELECT query_id, song_id, chunk_id AS best_chunk_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, song_id ORDER BY gain DESC, position, chunk_id) AS rn FROM gains) WHERE rn = 1),
lexical AS (SELECT t.*, c.best_chunk_id FROM lex_top t LEFT JOIN chosen c USING (query_id, song_id))"""

TFIDF = rf"""cterm AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), {TERMS})) AS term FROM chunks1),
cpost AS (SELECT chunk_id, term, count(*) AS tf FROM cterm GROUP BY ALL),
nd AS (SELECT count(*) AS n_docs FROM chunks1),
cidf AS (SELECT term, count(*) AS df, sum(tf) AS cf, ln((1 + any_value(n_docs)) / (1 + count(*))) + 1 AS idf FROM cpost, nd GROUP BY term),
cw AS (SELECT chunk_id, term, tf * idf AS w FROM cpost JOIN cidf USING (term)),
cvec AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight FROM cw)"""

DENSE = rf"""{TFIDF},
qpost AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), {TERMS})) AS term FROM searches) GROUP BY ALL),
qw AS (SELECT query_id, term, tf * idf AS w FROM qpost JOIN cidf USING (term)),
qvec AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qw),
dscore AS (SELECT query_id, chunk_id, round(sum(q.weight * c.weight), 6) AS score FROM qvec q JOIN cvec c USING (term) GROUP BY ALL),
dtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS crank FROM dscore WHERE score > 0) WHERE crank <= 50),
dsong AS (SELECT query_id, song_id, max(score) AS score, arg_min(chunk_id, crank) AS best_chunk_id FROM dtop JOIN (SELECT chunk_id, song_id FROM chunks1) USING (chunk_id) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM dsong)"""

HYBRID = """lists AS (SELECT query_id, song_id, rank, best_chunk_id, 0 AS lexical FROM dense UNION ALL SELECT query_id, song_id, rank, best_chunk_id, 1 FROM lexical),
fused AS (SELECT query_id, song_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS n_lists, min(rank) AS best_rank,
    coalesce(max(CASE WHEN lexical = 0 THEN best_chunk_id END), max(best_chunk_id)) AS best_chunk_id FROM lists GROUP BY ALL),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_lists DESC, best_rank, song_id) AS rank FROM fused)"""
