"""Queries of the text functions, section detection, ingest and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ingest, pooling, sections
from ..runtime import table
from .base import CHUNKS, EVALS, SONGS, TERMS, TOKENS, WS, chunks, collapse_sql, dedupe_sql, eval_queries, id_sql, query, songs, strip_sql, words_sql

_ARTIST, _TITLE = "coalesce(artist, '')", "coalesce(title, '')"


@query(f"WITH {SONGS} SELECT song_id, len(regexp_extract_all(text_raw, {TOKENS})) AS n_tokens, md5(lower(array_to_string(regexp_extract_all(text_raw, {TOKENS}), ' '))) AS tokens FROM songs1 WHERE text_raw IS NOT NULL")
def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    t = tx.tokenize_words(F.col("text_raw"))
    return songs(spark, d).where("text_raw is not null").select("song_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query(f"WITH {SONGS} SELECT song_id, md5({collapse_sql('text_raw')}) AS collapsed, {words_sql('text_raw')} AS n_words FROM songs1 WHERE text_raw IS NOT NULL")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text_raw")
    return songs(spark, d).where("text_raw is not null").select("song_id", F.md5(tx.collapse_whitespace(c)).alias("collapsed"), tx.word_count(c).cast("bigint").alias("n_words"))


@query(f"WITH {SONGS} SELECT song_id, substr(sha1({id_sql(_ARTIST)} || '|' || {id_sql(_TITLE)}), 1, 16) AS made_id FROM songs1")
def song_ids(spark: SparkSession, d: str) -> DataFrame:
    return songs(spark, d).select("song_id", tx.make_song_id(F.col("artist"), F.col("title")).alias("made_id"))


@query(f"WITH {CHUNKS} SELECT chunk_id, sha1({dedupe_sql('text')}) AS block FROM chunks1 WHERE text IS NOT NULL")
def block_hashes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("text is not null").select("chunk_id", tx.hash_block(F.col("text")).alias("block"))


@query(f"WITH {CHUNKS} SELECT chunk_id, len(regexp_extract_all(lower(text), {TERMS})) AS n_terms, md5(array_to_string(regexp_extract_all(lower(text), {TERMS}), ' ')) AS terms FROM chunks1 WHERE text IS NOT NULL")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    t = tx.tfidf_terms(F.col("text"))
    return chunks(spark, d).where("text is not null").select("chunk_id", F.size(t).cast("bigint").alias("n_terms"), F.md5(F.array_join(t, " ")).alias("terms"))


def _cut(x: str, w: int) -> str:
    return f"CASE WHEN length({x}) <= {w} THEN {x} ELSE rtrim(substr({x}, 1, {w - 1}), ' ') || '…' END"


@query(
    f"""WITH {CHUNKS}, lines AS (SELECT chunk_id, n, {strip_sql('line')} AS line FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM chunks1 WHERE text IS NOT NULL)),
kept AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n) AS k FROM lines WHERE line <> ''),
joined AS (SELECT chunk_id, string_agg({_cut('line', 90)}, ' / ' ORDER BY k) AS snippet FROM kept WHERE k <= 2 GROUP BY 1)
SELECT c.chunk_id, coalesce(j.snippet, '') AS snippet, substr(c.text, 1, 80) AS preview, replace(substr(c.text, 1, 80), chr(10), ' ') AS one_line, {_cut('c.text', 40)} AS short FROM chunks1 c LEFT JOIN joined j USING (chunk_id) WHERE c.text IS NOT NULL"""
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    shown = chunks(spark, d).where("text is not null")
    return shown.select("chunk_id", tx.snippet(c).alias("snippet"), tx.preview(c).alias("preview"), tx.one_line_preview(c).alias("one_line"), tx.truncate(c, 40).alias("short"))


@query(
    rf"""WITH {SONGS}, l AS (SELECT song_id, list_transform(string_split(text_raw, chr(10)), lambda x: regexp_replace(x, '{WS}+$', '')) AS ls FROM songs1 WHERE text_raw IS NOT NULL),
f AS (SELECT song_id, ls, list_min(list_filter(range(1, len(ls) + 1), lambda i: ls[i] <> '')) AS first FROM l),
b AS (SELECT song_id, CASE WHEN first IS NULL THEN [] ELSE ls[first:] END AS body FROM f)
SELECT song_id, array_to_string(body[1:8], chr(10)) || CASE WHEN len(body) > 8 THEN chr(10) || '… ' || (len(body) - 8) || ' more lines' ELSE '' END AS block FROM b"""
)
def lyrics_blocks(spark: SparkSession, d: str) -> DataFrame:
    return songs(spark, d).where("text_raw is not null").select("song_id", tx.lyrics_block(F.col("text_raw")).alias("block"))


@query(f"WITH {EVALS} SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'fenced' WHEN 2 THEN 'missing_field' ELSE 'unparseable' END AS mode, CASE WHEN query_id % 4 < 2 THEN query END AS paraphrase FROM evals1 WHERE query IS NOT NULL")
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    q = eval_queries(spark, d).where("query is not null")
    full = F.to_json(F.struct(F.col("query").alias("paraphrase"), F.lit("about it").alias("description")))
    half = F.to_json(F.struct(F.col("query").alias("paraphrase")))
    n = F.col("query_id") % 4
    raw = F.when(n == 0, full).when(n == 1, F.concat(F.lit("Here you are:\n```json\n"), full, F.lit("\n```\n"))).when(n == 2, half).otherwise(F.lit("I cannot do that."))
    obj, mode = tx.parse_reply(raw)
    return q.select("query_id", mode.alias("mode"), obj["paraphrase"].alias("paraphrase"))


@query(f"WITH {CHUNKS} SELECT chunk_id, regexp_replace(chunk_id, ':[^:]*$', '') AS of_song, translate(lower(section), 'ehcorsv', 'abdflmn') AS folded FROM chunks1")
def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", tx.song_of_chunk(F.col("chunk_id")).alias("of_song"), tx.fold_key(F.col("section"), "ehcorsv", "abdflmn").alias("folded"))


_NAMES = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sections.SINGLE_NAMES.items()) + " END"
_PAIR = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sections.PAIR_NAMES.items()) + " END"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z]+')"


def _bracket_section(x: str) -> str:
    s = strip_sql(x)
    lead = f"lower(regexp_extract({s}, '^[A-Za-z]+'))"
    return f"CASE WHEN {lead} <> '' THEN coalesce({_NAMES.format(lead)}, {_PAIR.format(f'array_to_string({_tokens(s)}[1:2], chr(32))')}) END"


@query(
    rf"""WITH {SONGS}, b AS (SELECT song_id, unnest(regexp_extract_all(text_raw, '\[([^\]]*)\]', 1)) AS content FROM songs1)
SELECT content, CASE WHEN NOT regexp_matches(content, '[A-Za-z]') THEN 'noise' WHEN section IS NOT NULL THEN 'canonical' ELSE 'credits' END AS kind, section, n
FROM (SELECT content, {_bracket_section('content')} AS section, count(*) AS n FROM b GROUP BY content)"""
)
def bracket_classes(spark: SparkSession, d: str) -> DataFrame:
    found = songs(spark, d).select(F.explode(F.regexp_extract_all("text_raw", F.lit(r"\[([^\]]*)\]"), F.lit(1))).alias("content"))
    c = F.col("content")
    return found.groupBy("content").agg(F.count(F.lit(1)).alias("n")).select("content", sections.bracket_kind(c).alias("kind"), sections.bracket_section(c).alias("section"), "n")


_LABEL = (
    "CASE WHEN len(t) BETWEEN 1 AND 2 AND NOT regexp_matches(line, '[\\[\\]]') THEN coalesce("
    + f"CASE WHEN len(t) = 2 THEN {_PAIR.format('array_to_string(t, chr(32))')} END, {_NAMES.format('t[1]')}, {_NAMES.format('t[2]')}) END"
)


@query(
    f"""WITH {SONGS}, l AS (SELECT line, count(*) AS n, {_tokens('line')} AS t FROM (SELECT unnest(string_split(text_raw, chr(10))) AS line FROM songs1) GROUP BY line)
SELECT line, section, n FROM (SELECT line, n, {_LABEL} AS section FROM l) WHERE section IS NOT NULL"""
)
def plain_labels(spark: SparkSession, d: str) -> DataFrame:
    lines = songs(spark, d).select(F.explode(F.split("text_raw", "\n", -1)).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return lines.select("line", sections.label_section(F.col("line")).alias("section"), "n").where("section is not null")


# boundaries become chr(1) + kind + name + chr(2), and one split gives the segments
_SEGMENTS = rf"""lines AS (SELECT song_id, n, line, {_tokens('line')} AS t FROM (
    SELECT song_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS n
    FROM (SELECT song_id, regexp_replace(text_raw, '\[[^\]A-Za-z]*\]', '', 'g') AS x FROM songs1 WHERE text_raw IS NOT NULL))),
marked AS (SELECT song_id, regexp_replace(regexp_replace(string_agg(coalesce(chr(1) || 'P' || ({_LABEL}) || chr(2), line), chr(10) ORDER BY n), '\[([^\]\x01]*)(\x01P[^\]]*\])', chr(1) || 'B\1\2', 'g'),
    '\[([^\]\x01]*)\]', chr(1) || 'B\1' || chr(2), 'g') AS x FROM lines GROUP BY 1),
parts AS (SELECT song_id, generate_subscripts(string_split(x, chr(1)), 1) AS i, unnest(string_split(x, chr(1))) AS part FROM marked),
cut AS (SELECT song_id, i, string_split(part, chr(2))[1] AS head, CASE WHEN i = 1 THEN part ELSE substr(part, length(string_split(part, chr(2))[1]) + 2) END AS body FROM parts),
outer_ AS (SELECT song_id, i, {strip_sql('body')} AS text,
    CASE WHEN i = 1 THEN NULL WHEN head LIKE 'P%' THEN substr(head, 2) ELSE {_bracket_section('substr(head, 2)')} END AS section,
    CASE WHEN i = 1 THEN 'none' WHEN head LIKE 'P%' THEN 'plain_label' ELSE 'bracket_tag' END AS split_by FROM cut),
segs AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY i) - 1 AS position, text, section, split_by FROM outer_ WHERE text <> '')"""


@query(f"WITH {SONGS}, {_SEGMENTS} SELECT song_id, position, section, split_by, md5(text) AS text FROM segs")
def outer_segments(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d).select("song_id", F.posexplode(sections.outer_segments(F.col("text_raw"))).alias("position", "s"))
    return s.select("song_id", F.col("position").cast("bigint").alias("position"), "s.section", "s.split_by", F.md5("s.text").alias("text"))


_REFINED = rf"""bl AS (SELECT song_id, position, section, split_by, text, list_filter(list_transform(string_split(regexp_replace(text, '\n{WS}*\n', chr(3), 'g'), chr(3)), lambda p: {strip_sql('p')}), lambda p: p <> '') AS ps FROM segs),
refined AS (SELECT song_id, position, section, CASE WHEN len(ps) > 1 THEN 'blank_line' ELSE split_by END AS split_by, unnest(CASE WHEN len(ps) > 1 THEN ps ELSE [text] END) AS text FROM bl)"""


@query(f"WITH {SONGS}, {_SEGMENTS}, {_REFINED} SELECT song_id, section, split_by, md5(text) AS text, count(*) AS n FROM refined GROUP BY ALL")
def refined_segments(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d).select("song_id", F.explode(sections.refine_by_blank_lines(sections.outer_segments(F.col("text_raw")))).alias("s"))
    return s.groupBy("song_id", "s.section", "s.split_by", F.md5("s.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SONGS}, {_SEGMENTS}, {_REFINED} SELECT song_id, count(*) AS n_oversized FROM refined WHERE {words_sql('text')} > 120 GROUP BY 1")
def oversized_segments(spark: SparkSession, d: str) -> DataFrame:
    return sections.oversized_segments(songs(spark, d)).select("song_id", F.col("n_oversized").cast("bigint").alias("n_oversized"))


@query(f"WITH {SONGS}, {_SEGMENTS} SELECT song_id, md5({strip_sql('string_agg(text, chr(10) ORDER BY position)')}) AS text FROM segs GROUP BY 1")
def whole_songs(spark: SparkSession, d: str) -> DataFrame:
    return sections.chunk_songs(songs(spark, d), "whole_song").select("song_id", F.md5("text").alias("text"))


@query(f"WITH {CHUNKS} SELECT chunk_id, replace(substr(text, 1, 80), chr(10), ' ') AS line FROM chunks1")
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", tx.one_line_preview(F.col("text")).alias("line"))


@query(
    f"""WITH {SONGS}, k AS (SELECT {id_sql("coalesce(artist, '') || ' ' || coalesce(title, '')")} AS k, song_id AS id FROM songs1),
g AS (SELECT k, count(*) AS n_rows FROM k WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n_rows DESC, k LIMIT 5)
SELECT k, n_rows, array_to_string(list_sort(list_distinct(list(id)))[1:3], ' ') AS ids FROM g JOIN k USING (k) GROUP BY 1, 2"""
)
def duplicate_samples(spark: SparkSession, d: str) -> DataFrame:
    key = tx.normalize_for_id(F.concat_ws(" ", F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit(""))))
    return ingest.duplicate_samples(songs(spark, d), key, "song_id").withColumn("ids", F.array_join("ids", " "))


# the packing of lines is a fold, one step of the recursion a line
_LINE_WORDS = words_sql("line")
_LONG_LINE = rf"""CASE WHEN NOT contains(regexp_replace(line, '([.!?]){WS}+', '\1' || chr(3), 'g'), chr(3))
    THEN list_transform(range(0, ceil({_LINE_WORDS} / 120)::BIGINT), lambda g: array_to_string(regexp_extract_all(line, '[^{WS[1:]}+')[g * 120 + 1 : g * 120 + 120], ' '))
    ELSE list_filter(string_split(regexp_replace(line, '([.!?]){WS}+', '\1' || chr(3), 'g'), chr(3)), lambda x: {strip_sql('x')} <> '') END"""
_PACKED = rf"""pieces AS (SELECT song_id, position, section, CASE WHEN len(ps) > 1 THEN 'blank_line' ELSE split_by END AS split_by, CASE WHEN len(ps) > 1 THEN ps ELSE [text] END AS texts FROM bl),
ref AS (SELECT song_id, position, generate_subscripts(texts, 1) AS j, section, split_by, unnest(texts) AS text FROM pieces),
big AS (SELECT song_id, position, j, list_filter(string_split(text, chr(10)), lambda x: {strip_sql('x')} <> '') AS ls FROM ref WHERE {words_sql('text')} > 120),
fold AS (SELECT song_id, position, j, ls, 0::BIGINT AS i, []::VARCHAR[] AS done, '' AS cur, 0::BIGINT AS n FROM big
    UNION ALL SELECT song_id, position, j, ls, i + 1,
        CASE WHEN lw > 120 THEN list_concat(flushed, {_LONG_LINE}) WHEN (CASE WHEN n + lw > 120 THEN lw ELSE n + lw END) >= 80 THEN list_append(CASE WHEN n + lw > 120 THEN flushed ELSE done END, CASE WHEN n + lw > 120 OR cur = '' THEN line ELSE cur || chr(10) || line END)
            WHEN n + lw > 120 THEN flushed ELSE done END,
        CASE WHEN lw > 120 OR (CASE WHEN n + lw > 120 THEN lw ELSE n + lw END) >= 80 THEN '' WHEN n + lw > 120 OR cur = '' THEN line ELSE cur || chr(10) || line END,
        CASE WHEN lw > 120 OR (CASE WHEN n + lw > 120 THEN lw ELSE n + lw END) >= 80 THEN 0 WHEN n + lw > 120 THEN lw ELSE n + lw END
    FROM (SELECT *, {_LINE_WORDS} AS lw, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS flushed FROM (SELECT *, ls[i + 1] AS line FROM fold WHERE i < len(ls)))),
packed AS (SELECT song_id, position, j, list_filter(list_transform(CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END, lambda x: {collapse_sql('x')}), lambda x: x <> '') AS texts FROM fold WHERE i = len(ls)),
every AS (SELECT r.song_id, r.position, r.j, section, split_by, texts IS NOT NULL AS force_split, coalesce(texts, [text]) AS texts FROM ref r LEFT JOIN packed p ON p.song_id = r.song_id AND p.position = r.position AND p.j = r.j),
flat AS (SELECT song_id, position, j, generate_subscripts(texts, 1) AS k, section, split_by, force_split, unnest(texts) AS text FROM every),
made AS (SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY position, j, k) - 1)::INT AS position, section, text, split_by, force_split FROM flat)"""
_BL = _REFINED[: _REFINED.index("refined AS")].rstrip().rstrip(",")
_CHUNKED = f"WITH RECURSIVE {SONGS}, {_SEGMENTS}, {_BL}, {_PACKED}"


@query(f"{_CHUNKED} SELECT song_id || ':' || position AS chunk_id, song_id, section, text, position, split_by, force_split FROM made")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sections.chunk_songs(songs(spark, d))


@query(
    rf"""WITH {SONGS}, p AS (SELECT song_id, unnest(string_split(regexp_replace(regexp_replace(text_raw, '\[[^\n\r]*?\]', '', 'g'), '\n{WS}*\n', chr(3), 'g'), chr(3))) AS p FROM songs1)
SELECT song_id, count(*) AS n_paragraphs FROM p WHERE {strip_sql('p')} <> '' GROUP BY 1"""
)
def untagged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(sections.untagged_paragraphs(F.col("text_raw"))).cast("bigint")
    return songs(spark, d).select("song_id", n.alias("n_paragraphs")).where("n_paragraphs > 0")


@query(f"WITH {SONGS} SELECT * EXCLUDE (text_raw), md5(text_raw) AS text_raw FROM songs1")
def ingest_songs(spark: SparkSession, d: str) -> DataFrame:
    return songs(spark, d).withColumn("text_raw", F.md5("text_raw"))


@query(f"WITH {SONGS} SELECT song_id, artist, title FROM songs1 ORDER BY md5(song_id || ':42'), song_id LIMIT 500")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return ingest.seeded_sample(songs(spark, d).select("song_id", "artist", "title"), "song_id", 500)


@query(f"WITH {SONGS} SELECT song_id, row_number() OVER (ORDER BY song_id) AS n FROM songs1")
def id_order(spark: SparkSession, d: str) -> DataFrame:
    from ..runtime import ranked

    return ranked(songs(spark, d).select("song_id"), [], [F.asc("song_id")], "n")


_TRANSLATION = r"regexp_matches(coalesce(artist, ''), '(?i)\btranslations?\b') OR regexp_matches(coalesce(title, ''), '(?i)\btranslations?\b')"


@query(f"WITH {SONGS} SELECT song_id, ({_TRANSLATION}) AS is_translation FROM songs1")
def translation_flags(spark: SparkSession, d: str) -> DataFrame:
    return ingest.judge_songs(songs(spark, d)).select("song_id", "is_translation")


_REASON = rf"""CASE WHEN {strip_sql("coalesce(text_raw, '')")} = '' THEN 'song_empty_text'
    WHEN regexp_matches({strip_sql('text_raw')}, '(?i)^\[?{WS}*instrumental{WS}*\]?$') THEN 'song_instrumental_only'
    WHEN {words_sql('text_raw')} < 10 THEN 'song_too_short' END"""


@query(f"WITH {SONGS} SELECT song_id, artist, title, {_REASON} AS reason FROM songs1 WHERE ({_REASON}) IS NOT NULL")
def song_rejects(spark: SparkSession, d: str) -> DataFrame:
    return ingest.judge_songs(songs(spark, d)).where("reject_reason is not null").select("song_id", "artist", "title", F.col("reject_reason").alias("reason"))


_CHUNK_REASON = f"""judged AS (SELECT *, CASE WHEN position > min(position) OVER (PARTITION BY song_id, {dedupe_sql("coalesce(text, '')")}) THEN 'chunk_duplicate_block'
    WHEN length(coalesce(text, '')) < 15 THEN 'chunk_too_short' END AS reason FROM chunks1)"""


@query(f"WITH {CHUNKS}, {_CHUNK_REASON} SELECT chunk_id, song_id, position, reason, substr(text, 1, 80) AS text_preview FROM judged WHERE reason IS NOT NULL")
def chunk_rejects(spark: SparkSession, d: str) -> DataFrame:
    judged = ingest.judge_chunks(chunks(spark, d)).where("reject_reason is not null")
    return judged.select("chunk_id", "song_id", "position", F.col("reject_reason").alias("reason"), tx.preview(F.col("text")).alias("text_preview"))


@query(f"WITH {CHUNKS}, {_CHUNK_REASON} SELECT coalesce(reason, 'passed') AS outcome, count(*) AS n FROM judged GROUP BY 1")
def chunk_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.judge_chunks(chunks(spark, d)).groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_KEPT = f"kept AS (SELECT song_id, artist, title, ({_REASON}) AS reason FROM songs1)"
_MADE = f"""judged AS (SELECT *, CASE WHEN position > min(position) OVER (PARTITION BY song_id, {dedupe_sql("text")}) THEN 'chunk_duplicate_block' WHEN length(text) < 15 THEN 'chunk_too_short' END AS why
    FROM made JOIN (SELECT song_id, artist, title FROM kept WHERE reason IS NULL) USING (song_id))"""


@query(
    f"""{_CHUNKED}, {_KEPT}, {_MADE}
SELECT 'song' AS level, reason, song_id, artist, title, NULL::INT AS position, NULL::VARCHAR AS text_preview, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS embedder_name FROM kept WHERE reason IS NOT NULL
UNION ALL SELECT 'chunk', why, song_id, artist, title, position, substr(text, 1, 80), NULL, NULL FROM judged WHERE why IS NOT NULL"""
)
def preprocess_rejects(spark: SparkSession, d: str) -> DataFrame:
    return ingest.preprocess(songs(spark, d))[2]


@query(
    f"""{_CHUNKED}, {_KEPT}, {_MADE} SELECT (SELECT count(*) FROM kept) AS songs_in, (SELECT count(*) FROM kept WHERE reason IS NOT NULL) AS songs_rejected, count(*) AS chunks_in,
    count(*) FILTER (why IS NULL) AS chunks_passed, count(why) AS chunks_rejected, true AS adds_up FROM judged"""
)
def preprocess_conservation(spark: SparkSession, d: str) -> DataFrame:
    flagged, passed, rejects = ingest.preprocess(songs(spark, d))
    kept = ingest.judge_songs(songs(spark, d)).where("reject_reason is null")
    return ingest.conservation(flagged, sections.chunk_songs(kept), passed, rejects)


@query(f"WITH {CHUNKS} SELECT split_by, force_split, count(*) AS n FROM chunks1 GROUP BY ALL")
def split_cross_table(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("split_by", "force_split").agg(F.count(F.lit(1)).alias("n"))


def _dup(name: str, key: str) -> str:
    return f"SELECT '{name}' AS key_kind, count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows, coalesce(sum(n - 1), 0)::BIGINT AS n_extra FROM (SELECT {key} AS k, count(*) AS n FROM songs WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


@query(" UNION ALL ".join([_dup("song_id", "song_id"), _dup("artist_title", f"{id_sql('artist')} || '|' || {id_sql('title')}"), _dup("text", f"sha1({dedupe_sql('text_raw')})")]))
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    keys = {"song_id": c("song_id"), "artist_title": F.concat(tx.normalize_for_id(c("artist")), F.lit("|"), tx.normalize_for_id(c("title"))), "text": tx.hash_block(c("text_raw"))}
    return ingest.duplicate_summary(table(spark, d, "songs"), keys)


_LANG = "l AS (SELECT song_id, doc_id, lower(lang) AS lang FROM documents WHERE song_id IN (SELECT song_id FROM songs) AND lang IS NOT NULL)"


def _lookup(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("song_id", "doc_id", F.lower("lang").alias("lang"))
    return ingest.build_lookup(docs, table(spark, d, "songs"), "song_id", "doc_id", "lang")


@query(f"WITH {_LANG} SELECT song_id, arg_min(lang, doc_id) AS lang FROM l GROUP BY 1")
def genre_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d)[0]


@query(f"WITH {_LANG} SELECT count(*) AS n_tagged, coalesce(sum((lo <> hi)::INT), 0)::BIGINT AS n_conflicts, (SELECT count(DISTINCT song_id) FROM songs) AS n_known FROM (SELECT min(lang) AS lo, max(lang) AS hi FROM l GROUP BY song_id)")
def genre_lookup_stats(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d)[1]


@query(f"WITH {_LANG} SELECT lang, count(*) AS n FROM (SELECT song_id, arg_min(lang, doc_id) AS lang FROM l GROUP BY 1) GROUP BY 1")
def genre_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d)[0].groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVALS}, e AS (SELECT query_id, unnest(list_distinct(relevant_song_ids)) AS song_id FROM evals1) SELECT query_id, count(*) AS n_relevant, sum((song_id NOT IN (SELECT song_id FROM songs))::INT)::BIGINT AS n_unknown FROM e GROUP BY 1")
def eval_set_check(spark: SparkSession, d: str) -> DataFrame:
    ids = eval_queries(spark, d).select("query_id", F.explode(F.array_distinct("relevant_song_ids")).alias("song_id"))
    known = table(spark, d, "songs").select("song_id").distinct().withColumn("known", F.lit(True))
    return ids.join(known, "song_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.col("known").isNull().cast("bigint")).alias("n_unknown"))


@query(f"WITH {CHUNKS}, {SONGS} SELECT song_id, count(c.chunk_id) AS n_chunks, sum(({words_sql('c.text')} > 120)::INT)::BIGINT AS n_long FROM songs1 LEFT JOIN chunks1 c USING (song_id) GROUP BY 1")
def chunks_per_song(spark: SparkSession, d: str) -> DataFrame:
    per = chunks(spark, d).groupBy("song_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum((tx.word_count(F.col("text")) > 120).cast("bigint")).alias("n_long"))
    return songs(spark, d).select("song_id").join(per, "song_id", "left").select("song_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "n_long")


@query(f"WITH {CHUNKS} SELECT song_id FROM chunks1 GROUP BY 1 HAVING min(split_by) = max(split_by) AND count(*) = count(split_by) AND min(split_by) IN ('none', 'plain_label')")
def structural_songs(spark: SparkSession, d: str) -> DataFrame:
    return pooling.structural_songs(chunks(spark, d))
