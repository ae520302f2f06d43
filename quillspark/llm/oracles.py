"""SQL for the queries that SQL can state on whole tables.

Problems 7 to 9 have none: tokens, packing and
sentences are tested against libraries, invariants and written cases.
"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

_TEXTS = """texts AS (SELECT 'song' AS record_kind, song_id AS record_id, max(text_raw) AS text FROM songs GROUP BY song_id
    UNION ALL SELECT 'chunk', chunk_id, max(text) FROM chunks GROUP BY chunk_id)"""

P1 = rf"""WITH {_TEXTS}, w AS (SELECT record_kind, record_id, {_WORDS.format('text')} AS w FROM texts),
g AS (SELECT record_kind, record_id, i, array_to_string(w[i:i+3], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT record_kind, record_id, i FROM (SELECT *, row_number() OVER (PARTITION BY record_kind, record_id, gram ORDER BY i) AS n FROM g) WHERE n > 1),
places AS (SELECT DISTINCT record_kind, record_id, unnest(range(i, i + 4)) AS place FROM again),
n AS (SELECT record_kind, record_id, count(*) AS n FROM places GROUP BY ALL)
SELECT record_kind, record_id FROM n JOIN w USING (record_kind, record_id) WHERE n.n * 2 > len(w)"""

_BLANKS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
P1_REPETITION = rf"""WITH texts AS (SELECT 'song' AS record_kind, song_id AS record_id, max(text_raw) AS text, max(lower(trim(artist))) AS host FROM songs GROUP BY song_id
    UNION ALL SELECT 'chunk', chunk_id, max(text), max(song_id) FROM chunks GROUP BY chunk_id),
w AS (SELECT record_kind, record_id, coalesce(host, '(none)') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM texts),
g AS (SELECT record_kind, record_id, i, array_to_string(w[i:i+3], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM w)),
again AS (SELECT record_kind, record_id, i FROM (SELECT *, row_number() OVER (PARTITION BY record_kind, record_id, gram ORDER BY i) AS n FROM g) WHERE n > 1),
n AS (SELECT record_kind, record_id, count(*) AS n FROM (SELECT DISTINCT record_kind, record_id, unnest(range(i, i + 4)) AS place FROM again) GROUP BY ALL),
p AS (SELECT *, [list_filter(list_transform(x, lambda t: lower(trim(regexp_replace(t, '{_BLANKS}', ' ', 'g')))), lambda t: t <> '') FOR x IN
    [string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]'), string_split_regex(text, '(?:\r\n|\r|\n)\s*(?:\r\n|\r|\n)')]] AS parts FROM w),
s AS (SELECT record_kind, record_id, host, len(w) AS n_words, [coalesce(1 - list_sum(list_transform(list_distinct(x), lambda t: len(t))) / list_sum(list_transform(x, lambda t: len(t))), 0.0) FOR x IN parts] AS shares FROM p),
d AS (SELECT record_kind, record_id, host, n_words, coalesce(n, 0) AS repeated_words, CASE WHEN n_words > 0 THEN coalesce(n, 0) / n_words ELSE 0.0 END AS repeated_share, shares[1] AS dup_line_share, shares[2] AS dup_paragraph_share,
    n_words >= 8 AND coalesce(n, 0) * 2 > n_words AS fails_phrase, n_words >= 8 AND (coalesce(n, 0) * 2 > n_words OR shares[1] > 0.5 OR shares[2] > 0.5) AS fails FROM s LEFT JOIN n USING (record_kind, record_id)),
h AS (SELECT record_kind, host, count(*) AS host_documents, count(*) FILTER (fails) AS host_failures, count(*) FILTER (fails) / count(*) AS host_rate FROM d GROUP BY ALL),
mo AS (SELECT record_kind, sum(host_failures) / sum(host_documents) AS mean, var_pop(host_rate) AS var, avg(1.0 / host_documents) AS inv FROM h GROUP BY 1),
b AS (SELECT *, greatest(var - mean * (1 - mean) * inv, 0) AS between_hosts FROM mo),
pr AS (SELECT record_kind, mean, least(CASE WHEN between_hosts <= 0 THEN 1e6 ELSE greatest(mean * (1 - mean) / between_hosts - 1, 1e-3) END, 1e6) AS strength FROM b),
v AS (SELECT record_kind, host, host_documents, host_failures, host_rate, (host_failures + mean * strength) / (host_documents + strength) AS shrunk FROM h JOIN pr USING (record_kind))
SELECT record_kind, record_id, n_words::INT AS n_words, repeated_words::INT AS repeated_words, round(repeated_share, 9) AS repeated_share, round(dup_line_share, 9) AS dup_line_share, round(dup_paragraph_share, 9) AS dup_paragraph_share, fails_phrase,
    host, host_documents, host_failures, round(host_rate, 9) AS host_rate, round(shrunk, 9) AS host_shrunk_rate, CASE WHEN shrunk > 0.5 THEN 'repetitive' ELSE 'ok' END AS host_verdict,
    CASE WHEN fails_phrase THEN 'repetitive' WHEN shrunk > 0.5 THEN 'suspect' ELSE 'ok' END AS verdict
FROM d JOIN v USING (record_kind, host)"""

_PEOPLE = r"""pop AS (SELECT 'stratum' AS dimension, query_id::VARCHAR AS id, max(lower(regexp_replace(stratum, '^[ \t]+|[ \t]+$', '', 'g'))) AS category FROM eval_queries GROUP BY query_id
    UNION ALL SELECT 'is_translation', song_id, max(is_translation::VARCHAR) FROM songs GROUP BY song_id
    UNION ALL SELECT 'split_by', chunk_id, max(lower(regexp_replace(split_by, '^[ \t]+|[ \t]+$', '', 'g'))) FROM chunks GROUP BY chunk_id),
tot AS (SELECT dimension, count(*) AS total FROM pop GROUP BY 1), av AS (SELECT dimension, category, count(*) AS available FROM pop GROUP BY ALL),
rep AS (SELECT plan_id, dimension, lower(trim(category)) AS category, total, coalesce(available, 0) AS available,
    greatest(min_rows, floor(target_share::DECIMAL(10,6) * sample_fraction::DECIMAL(10,6) * total + 0.5))::BIGINT AS wanted
    FROM sample_targets JOIN tot USING (dimension) LEFT JOIN av USING (dimension, category))"""

P2_REPORT = f"WITH {_PEOPLE} SELECT plan_id, dimension, category, total, available, wanted, least(wanted, available) AS taken, greatest(wanted - available, 0) AS deficit FROM rep"
P2_FOUND = f"WITH {_PEOPLE} SELECT plan_id, category FROM rep WHERE available < wanted"

# the wanted rows of smallest draw, whatever the acceptance probability was
P2_SAMPLE = f"""WITH {_PEOPLE}, plan AS (SELECT DISTINCT plan_id, dimension, category, wanted FROM rep WHERE available > 0),
drawn AS (SELECT plan_id, dimension, category, id AS record_id, wanted, ('0x' || substr(md5('42:' || plan_id || ':' || id), 1, 13))::BIGINT AS u FROM plan JOIN pop USING (dimension, category))
SELECT plan_id, dimension, category, record_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, dimension, category ORDER BY u, record_id) AS n FROM drawn) WHERE n <= wanted"""

_CLOSENESS = """latest AS (SELECT query_id, arm, song_id, score FROM (
    SELECT query_id, arm, song_id, CASE WHEN NOT isnan(score) THEN score END AS score,
           row_number() OVER (PARTITION BY query_id, arm, song_id ORDER BY scored_at DESC NULLS LAST, CASE WHEN NOT isnan(score) THEN score END DESC NULLS LAST) AS rn
    FROM hits) WHERE rn = 1 AND score IS NOT NULL),
x AS (SELECT query_id, arm, song_id, CASE WHEN higher_is_better = false THEN -score ELSE score END AS x FROM latest LEFT JOIN retrieval_configs USING (arm)),
b AS (SELECT query_id, arm, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM x GROUP BY ALL),
h AS (SELECT query_id, arm, song_id, least(greatest(x, q1 - (q3 - q1) * 1.5), q3 + (q3 - q1) * 1.5) AS x FROM x JOIN b USING (query_id, arm)),
t AS (SELECT *, min(x) OVER (PARTITION BY query_id, arm) AS worst, max(x) OVER (PARTITION BY query_id, arm) AS best FROM h),
z AS (SELECT query_id, arm, song_id, CASE WHEN best > worst THEN (x - worst) / (best - worst) ELSE 0 END AS z FROM t),
nm AS (SELECT query_id, arm, CASE WHEN sum(z * z) > 0 THEN 1 / sqrt(sum(z * z)) ELSE 0 END AS ideal FROM z GROUP BY ALL),
w AS (SELECT query_id, sum(ideal * ideal) AS whole FROM nm GROUP BY 1),
s AS (SELECT query_id, song_id, count(*) AS n_arms, sum((ideal - z * ideal) * (ideal - z * ideal) - ideal * ideal) AS nearer, sum(z * ideal * z * ideal) AS from_worst
    FROM z JOIN nm USING (query_id, arm) GROUP BY ALL),
d AS (SELECT query_id, song_id, n_arms, sqrt(greatest(round(whole + nearer, 12), 0)) AS d_best, sqrt(from_worst) AS d_worst FROM s JOIN w USING (query_id)),
c AS (SELECT query_id, song_id, n_arms, round(CASE WHEN d_best + d_worst > 0 THEN d_worst / (d_best + d_worst) ELSE 0 END, 9) AS closeness FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, song_id) AS rank FROM c)"""

P3_FOUND = f"WITH {_CLOSENESS} SELECT query_id, song_id FROM r WHERE rank = 1"
P3_RANKING = f"WITH {_CLOSENESS} SELECT query_id, song_id, n_arms, round(closeness, 6) AS closeness, rank FROM r"

P4 = r"""WITH c AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY chunk_id),
t AS (SELECT chunk_id, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS x FROM c WHERE len(regexp_extract_all(text, '\S+')) > 120),
longest AS (SELECT chunk_id, list_max(list_transform(string_split(regexp_replace(x, '\n\s*\n', chr(1), 'g'), chr(1)), lambda p: len(regexp_extract_all(p, '\S+')))) AS paragraph,
    list_max(list_transform(string_split(x, chr(10)), lambda p: len(regexp_extract_all(p, '\S+')))) AS line,
    list_max(list_transform(string_split(regexp_replace(replace(x, chr(10), chr(1)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: len(regexp_extract_all(p, '\S+')))) AS sentence FROM t)
SELECT chunk_id, CASE WHEN paragraph <= 120 THEN 'paragraph' WHEN line <= 120 THEN 'line' WHEN sentence <= 120 THEN 'sentence' ELSE 'word' END AS cut_at FROM longest"""

# cuts[k]: word places before which a boundary of level k or coarser stands, and the end
P4_PIECES = r"""WITH RECURSIVE c AS (SELECT chunk_id, max({text: text, song_id: song_id, section: section, split_by: split_by}) AS m FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id),
t AS (SELECT chunk_id, m, regexp_extract_all(m.text, '\s*\S+') AS w FROM c), l AS (SELECT *, len(w) AS n FROM t WHERE len(w) > 120),
g AS (SELECT *, list_transform(range(2, n + 1), lambda i: {place: i - 1, gap: regexp_replace(regexp_extract(w[i], '^\s*'), '\r\n|\r', chr(10), 'g'), before: right(w[i - 1], 1)}) AS gaps FROM l),
v AS (SELECT chunk_id, m, w, n, list_transform(gaps, lambda x: {place: x.place, level: CASE WHEN len(x.gap) - len(replace(x.gap, chr(10), '')) >= 2 THEN 0 WHEN contains(x.gap, chr(10)) THEN 1 WHEN x.before IN ('.', '!', '?') THEN 2 ELSE 3 END}) AS b FROM g),
k AS (SELECT chunk_id, m, w, n, [list_append(list_transform(list_filter(b, lambda x: x.level <= 0), lambda x: x.place), n), list_append(list_transform(list_filter(b, lambda x: x.level <= 1), lambda x: x.place), n),
    list_append(list_transform(list_filter(b, lambda x: x.level <= 2), lambda x: x.place), n), range(1, n + 1)] AS cuts FROM v),
f AS (SELECT chunk_id, m, w, n, cuts, list_min(list_filter([1, 2, 3, 4], lambda j: j = 4 OR list_max(list_transform(range(1, len(cuts[j]) + 1), lambda i: cuts[j][i] - CASE WHEN i = 1 THEN 0 ELSE cuts[j][i - 1] END)) <= 120)) AS lev FROM k),
step AS (SELECT chunk_id, n, cuts, lev, 0::BIGINT AS piece, 0::BIGINT AS cut, 0::BIGINT AS nxt FROM f
    UNION ALL SELECT chunk_id, n, cuts, lev, piece + 1, nxt, list_max(list_filter(cuts[list_min(list_filter([1, 2, 3, 4], lambda j: j >= lev AND len(list_filter(cuts[j], lambda x: x > nxt AND x <= nxt + CASE WHEN nxt = 0 THEN 120 ELSE 105 END)) > 0))],
        lambda x: x > nxt AND x <= nxt + CASE WHEN nxt = 0 THEN 120 ELSE 105 END)) FROM step WHERE nxt < n)
SELECT chunk_id, m.song_id AS song_id, m.section AS section, m.split_by AS split_by, true AS force_split, ['paragraph', 'line', 'sentence', 'word'][f.lev] AS cut_at, (piece - 1)::INT AS piece,
    (count(*) OVER (PARTITION BY chunk_id))::INT AS n_pieces, (nxt - greatest(cut - 15, 0))::INT AS n_words, regexp_replace(array_to_string(w[greatest(cut - 15, 0) + 1 : nxt], ''), '^\s+', '') AS text
FROM step JOIN f USING (chunk_id) WHERE piece > 0"""

P5 = rf"""WITH s AS (SELECT song_id, {_WORDS.format(r"regexp_replace(max(text_raw), '\[[^\]]*\]', ' ', 'g')")} AS w FROM songs GROUP BY song_id),
g AS (SELECT DISTINCT song_id, hash(w[i], w[i+1], w[i+2]) AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 10)),
n AS (SELECT song_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.song_id AS song_id_a, b.song_id AS song_id_b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.song_id < b.song_id GROUP BY ALL)
SELECT song_id_a, song_id_b FROM shared JOIN n x ON x.song_id = song_id_a JOIN n y ON y.song_id = song_id_b WHERE shared * 2 >= x.n + y.n - shared"""

P5_GROUPS = rf"""WITH RECURSIVE s AS (SELECT song_id, {_WORDS.format(r"regexp_replace(max(text_raw), '\[[^\]]*\]', ' ', 'g')")} AS w FROM songs WHERE song_id IS NOT NULL GROUP BY song_id),
m AS (SELECT song_id, w, min(song_id) OVER (PARTITION BY w) AS rep FROM s WHERE len(w) >= 10),
g AS (SELECT DISTINCT song_id, hash(w[i], w[i+1], w[i+2]) AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM m WHERE song_id = rep)),
n AS (SELECT song_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.song_id AS a, b.song_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.song_id < b.song_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.song_id = a JOIN n y ON y.song_id = b WHERE shared * 2 >= x.n + y.n - shared),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), degree AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY 1),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS rep, min(b) AS group_id FROM reach GROUP BY 1)
SELECT s.song_id, coalesce(m.rep, s.song_id) AS rep, coalesce(group_id, m.rep, s.song_id) AS group_id, coalesce(n_links, 0) AS n_links
FROM s LEFT JOIN m USING (song_id) LEFT JOIN c ON c.rep = m.rep LEFT JOIN degree d ON d.rep = m.rep"""

_SHARED = rf"""c AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY chunk_id),
cw AS (SELECT chunk_id, unnest({_WORDS.format('text')}) AS term FROM c), ct AS (SELECT chunk_id, term, count(*) AS observed FROM cw GROUP BY ALL),
len AS (SELECT chunk_id, count(*) AS r FROM cw GROUP BY 1), tot AS (SELECT count(*) AS n FROM cw), nc AS (SELECT count(*) AS total FROM c),
st AS (SELECT term, sum(observed) AS c, count(*) AS df FROM ct GROUP BY 1),
q AS (SELECT query_id, max(source_chunk_id) AS chunk_id, unnest(list_distinct({_WORDS.format('max(query)')})) AS term FROM eval_queries GROUP BY query_id),
sh AS (SELECT query_id, chunk_id, term, observed, df AS n_records, (observed - r * c / n) / sqrt(r * c / n * (1 - r / n) * (1 - c / n)) AS residual, ln((1 + total) / (1 + df)) + 1 AS idf, total
    FROM q JOIN ct USING (chunk_id, term) JOIN len USING (chunk_id) JOIN st USING (term), tot, nc WHERE length(term) >= 2)"""

P6_FOUND = f"WITH {_SHARED} SELECT query_id, term FROM sh WHERE n_records <= 0.005 * total"
P6_WEIGHTS = f"WITH {_SHARED} SELECT query_id, chunk_id, term, observed, n_records, round(residual, 6) AS residual, round(idf, 6) AS idf FROM sh"
P6_SHARED = f"WITH {_SHARED} SELECT query_id, list(term ORDER BY term) AS shared, round(max(idf), 6) AS max_shared_idf, round(max(residual), 6) AS max_residual, arg_min(term, struct_pack(a := -round(residual, 9), b := term)) AS top_term FROM sh GROUP BY 1"

P8_FILL = "SELECT count(*) AS documents, 0::BIGINT AS over_capacity, 0::BIGINT AS broken, true AS well_filled FROM documents"

ORACLES = {
    "p1_found": P1,
    "p1_repetition": P1_REPETITION,
    "p2_found": P2_FOUND,
    "p2_sample": P2_SAMPLE,
    "p2_report": P2_REPORT,
    "p3_found": P3_FOUND,
    "p3_ranking": P3_RANKING,
    "p4_found": P4,
    "p4_pieces": P4_PIECES,
    "p5_found": P5,
    "p5_groups": P5_GROUPS,
    "p6_found": P6_FOUND,
    "p6_weights": P6_WEIGHTS,
    "p6_shared": P6_SHARED,
    "p8_fill": P8_FILL,
}
