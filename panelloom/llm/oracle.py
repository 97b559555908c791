"""The corpus queries as SQL over the driver's tables, by definition rather than by method."""

from __future__ import annotations

import string

from panelloom.llm import lines, secret_scan

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
SPACED = r"'[^\x20\x09-\x0D]+'"
PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = f"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({low('text')}, {PLAIN}) AS w FROM benchmark),
spans AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS span
           FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM spans)),
d AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, {PLAIN}) AS w FROM documents),
windows AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS span
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, k, x.n FROM windows x JOIN wanted USING (n, span)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP4 = """
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
kept AS (SELECT conv_id FROM c a WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE len(b.said) > len(a.said) AND b.said[1:len(a.said)] = a.said))
SELECT conv_id, turn, role,
       '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM conversations JOIN kept USING (conv_id)"""

OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


def spans_sql(pattern: str, rank: int, keep: str = "TRUE", source: str = "d") -> str:
    """(doc_id, start, rank, stop) of a pattern's matches: gaps and matches alternate. ``m`` is the match."""
    return f"""
SELECT doc_id, CAST(place AS BIGINT) AS start, {rank} AS rank, CAST(place + length(m) AS BIGINT) AS stop, m FROM (
  SELECT doc_id, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER earlier, 0) AS place FROM (
    SELECT doc_id, generate_subscripts(f, 1) AS k, unnest(f) AS m, unnest(g[1:len(f)]) AS g FROM (
      SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}) AS f, regexp_split_to_array(t, {quoted(pattern)}) AS g FROM {source}))
  WINDOW w AS (PARTITION BY doc_id ORDER BY k), earlier AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE {keep}"""


ENTROPY = secret_scan.EntropyConfig()
ASSIGN_RE2 = secret_scan.ASSIGN.replace("(?i:", "(?:").replace(
    "password|passwd|secret|token|api_?key", "(?i)password|passwd|secret|token|api_?key"
)
CANDIDATE = secret_scan.CANDIDATE + "{%d,}" % ENTROPY.window
UNLISTED = " AND ".join(f"NOT regexp_matches(m, {quoted(p)})" for p in ENTROPY.allowed)
OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
assign AS ({spans_sql(ASSIGN_RE2, 1, f"length(regexp_extract(m, {quoted(ASSIGN_RE2)}, 1)) >= {secret_scan.ASSIGN_VALUE}")}),
access AS ({spans_sql(secret_scan.ACCESS, 2)}),
hex AS ({spans_sql(secret_scan.HEX, 3)}),
base AS (SELECT doc_id, start, rank, stop FROM assign UNION ALL SELECT doc_id, start, rank, stop FROM access
         UNION ALL SELECT doc_id, start, rank, stop FROM hex),
found AS ({spans_sql(CANDIDATE, 4, UNLISTED)}),
hot AS (SELECT doc_id, start AS word, k, start + k - 1 AS a FROM (
          SELECT doc_id, start, m, unnest(range(1, length(m) - {ENTROPY.window} + 2)) AS k FROM found)
        WHERE list_aggregate(string_split(substr(m, CAST(k AS BIGINT), {ENTROPY.window}), ''), 'entropy')
              >= CASE {" ".join(f"WHEN regexp_full_match(m, '{c}+') THEN {b}" for c, b in ENTROPY.classes)} ELSE {ENTROPY.mixed_bits} END),
islands AS (SELECT *, sum(CASE WHEN a <= last + {ENTROPY.window} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, word ORDER BY a) AS island
            FROM (SELECT *, lag(a) OVER (PARTITION BY doc_id, word ORDER BY a) AS last FROM hot)),
runs AS (SELECT doc_id, min(a) AS start, 4 AS rank, max(a) + {ENTROPY.window} AS stop FROM islands GROUP BY doc_id, word, island),
every AS (SELECT * FROM base UNION ALL SELECT * FROM runs r WHERE NOT EXISTS (
            SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start <= r.start AND r.stop <= b.stop)),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][rank] || ':' || start || ':' || stop AS shown FROM every),
summed AS (SELECT doc_id, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access,
                  count(*) FILTER (rank = 3) AS n_hex, string_agg(shown, ',' ORDER BY start, rank, stop) FILTER (rank < 4) AS base,
                  string_agg(shown, ',' ORDER BY start, rank, stop) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN summed USING (doc_id)"""

HOST = f"CASE WHEN instr(url, '://') > 0 THEN {low("regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')")} ELSE '' END"
VISIBLE = "html"
for _pattern, _by in (
    (lines.HIDDEN, "chr(10)"), (lines.BREAKS, "chr(10)"), (lines.TAGS, "''")
):
    VISIBLE = f"regexp_replace({VISIBLE}, {quoted(_pattern)}, {_by}, 'g')"
for _entity, _character in lines.ENTITIES:
    VISIBLE = f"replace({VISIBLE}, {quoted(_entity)}, {quoted(_character)})"
LINE = lines.LineConfig()
OP7 = rf"""
WITH p AS (SELECT page_id, coalesce({HOST}, '') AS host, list_filter(list_transform(
             regexp_split_to_array({VISIBLE}, '[\n\r]+'),
             lambda s: regexp_replace(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g')), lambda s: s <> '') AS l
           FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)),
sizes AS (SELECT host, count(*) AS n FROM p GROUP BY host HAVING count(*) >= {LINE.pages}),
often AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(l)) AS line FROM p) JOIN sizes USING (host)
          GROUP BY host, line, n HAVING count(*) > n * CAST({LINE.ratio} AS DOUBLE)),
drops AS (SELECT host, list(line) AS gone FROM often GROUP BY host),
kept AS (SELECT page_id, p.host, l, list_filter(l, lambda s: NOT list_contains(coalesce(gone, []), s)) AS k
         FROM p LEFT JOIN drops ON p.host = drops.host)
SELECT page_id, host, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(k) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(k, chr(10)), '')) AS text_sha256 FROM kept"""

OP8 = f"""
WITH d AS (SELECT *, substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || size)), 1, 16) AS key FROM (
             SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {SPACED})), 0) AS size FROM documents)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][k % 3 + 1] AS weight FROM s),
l AS (SELECT *, 3 * sum(size) OVER () - 4 * coalesce(sum(size) OVER fuller, 0) AS remains,
             sum(weight) OVER () - coalesce(sum(weight) OVER fuller, 0) AS sharing
      FROM w WINDOW fuller AS (ORDER BY CAST(size AS DOUBLE) / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * remains >= 4 * size * sharing AS is_full FROM l),
t AS (SELECT source, size AS source_size, CASE WHEN is_full THEN CAST(2 * size AS DOUBLE) ELSE
             CAST(weight * max(remains) FILTER (NOT is_full) OVER () AS DOUBLE)
             / CAST(2 * max(sharing) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target FROM f),
e AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
                                                       ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT size, CAST(upto + source_size * unnest([0, 1]) AS DOUBLE) / target AS ft FROM e WHERE size > 0),
r AS (SELECT ft, sum(size) OVER (ORDER BY ft) AS words FROM q),
cut AS (SELECT coalesce(max(ft), -1) AS last FROM r WHERE words <= (SELECT 3 * sum(size) // 2 FROM d))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (CAST(CAST(upto AS DOUBLE) / target <= last AS INTEGER)
            + CAST(CAST(upto + source_size AS DOUBLE) / target <= last AS INTEGER)) ELSE 0 END AS BIGINT) AS taken
FROM e, cut"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, {SPACED}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
          FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT l.b, r.other FROM reach r JOIN links l ON l.a = r.doc_id),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN least_of USING (doc_id)"""

PIECE = r"'[^.!?\n]+[.!?\n]*|[.!?\n]+'"
OP10 = f"""
WITH p AS (SELECT doc_id, t, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM (
             SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {PIECE}) AS p FROM documents)),
n AS (SELECT *, sum(length(piece)) OVER w AS stop, len(regexp_extract_all(piece, {SPACED})) >= 5 AS long FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
g AS (SELECT *, coalesce(sum(CAST(long AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM n),
s AS (SELECT doc_id, unit, any_value(t) AS t, CAST(min(stop - length(piece)) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop FROM g GROUP BY doc_id, unit),
u AS (SELECT *, regexp_extract_all({low("t[start + 1:stop]")}, {SPACED}) AS w FROM s),
f AS (SELECT doc_id, unit, start, stop, len(w) AS words, first_value(doc_id) OVER o AS first_doc, row_number() OVER o > 1 AS again
      FROM u WHERE len(w) > 0 WINDOW o AS (PARTITION BY w ORDER BY doc_id, unit)),
b AS (SELECT *, CASE WHEN lag(unit) OVER o = unit - 1 AND lag(first_doc) OVER o = first_doc THEN 0 ELSE 1 END AS new
      FROM f WHERE again WINDOW o AS (PARTITION BY doc_id ORDER BY unit)),
r AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM (
        SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM b) GROUP BY doc_id, run HAVING sum(words) > 25),
m AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM (
        SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM (
          SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY doc_id ORDER BY start) = start THEN 0 ELSE 1 END AS new FROM r)) GROUP BY doc_id, span),
l AS (SELECT doc_id, count(*) AS n_removed, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed FROM m GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY k) AS text FROM g
         WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.start < g.stop AND g.stop <= m.stop) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)"""

SHARE = "CASE WHEN {v} > 0 THEN 1 + (1000000000 * ({n} + 5)) // ({total} + 5 * {v}) ELSE 0 END"
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
             {low("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM x GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(term) AS v, coalesce(sum(all_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
had AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN had USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {SHARE.format(n="coalesce(n, 0)", total="total", v="v")} AS p,
             {SHARE.format(n="all_n", total="lang_total", v="v")} AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN had USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5"""

ORACLE = {
    "op2_decontamination": OP2,
    "op4_chat_format": OP4,
    "op5_exact_dedup": OP5,
    "op6_secret_scan": OP6,
    "op7_line_dedup": OP7,
    "op8_mixing": OP8,
    "op9_near_dedup": OP9,
    "op10_passage_dedup": OP10,
    "op11_source_divergence": OP11,
    "op13_hard_negatives": OP13,
}
