r"""DuckDB SQL of the text queries that SQL can express, each from the contract alone."""

from __future__ import annotations

from .quality import BOILERPLATE, LINKS, SEPARATORS

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
SMALL = f"translate(coalesce(text, ''), {UPPER}, {LOWER})"

#: crc32 of an id's digits, bit by bit
CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, d: list_reduce(list_concat([xor(c, d)], generate_series(1, 8)::BIGINT[]), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"

_SETS = f"w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({SMALL}, {WORD}) AS w FROM documents), s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM w WHERE len(w) > 0)), z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)"

OP2 = f"WITH RECURSIVE {_SETS}, c AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2), e AS MATERIALIZED (SELECT i, j FROM c JOIN z x ON x.doc_id = i JOIN z y ON y.doc_id = j WHERE 100 * k >= 75 * (x.n + y.n - k)), t AS MATERIALIZED (SELECT i AS a, j AS b FROM e UNION ALL SELECT j, i FROM e), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.b FROM r JOIN t ON t.a = r.b), m AS (SELECT a, min(b) AS c FROM r GROUP BY 1) SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN z USING (doc_id) JOIN m ON m.a = d.doc_id"

_LINES = "l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents), l1 AS MATERIALIZED (SELECT *, len(regexp_extract_all(line, " + WORD + ")) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) > 1 AS again FROM l0 WHERE regexp_matches(line, " + WORD + "))"


def _times(c: str, text: str = "line") -> str:
    return f"((length({text}) - length(replace({text}, '{c}', ''))) // {len(c)})"


_SYMBOLS = " + ".join(_times(c) for c in "#*$%&|<>")
_MARKS = " + ".join(_times(c) for c in SEPARATORS)
_PHRASE = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
_LINK = " OR ".join(f"contains(x, '{p}')" for p in LINKS)
_JUDGED = f"l2 AS MATERIALIZED (SELECT doc_id, n, again OR {_SYMBOLS} > 0.3::DOUBLE * n OR len(regexp_extract_all(line, '[!?]+')) + 0.3::DOUBLE * n < length(regexp_replace(line, '[^!?]', '', 'g')) OR (n <= 30 AND ({_PHRASE})) OR (n <= 30 AND {_MARKS} >= 2 AND n <= 3 * ({_MARKS} + 1)) OR 100 * len(list_filter(regexp_extract_all(low, {WORD}), lambda x: {_LINK})) > 50 * n AS bad, again FROM (SELECT *, translate(line, {UPPER}, {LOWER}) AS low FROM l1))"

OP6 = f"WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents), {_LINES}, {_JUDGED}, g AS MATERIALIZED (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM w WHERE len(w) > 2)), q AS (SELECT doc_id, count(DISTINCT x) AS r FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY 1), b AS (SELECT doc_id, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, sum(again::INTEGER) AS dup FROM l2 GROUP BY 1), a AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words FROM w LEFT JOIN q USING (doc_id) LEFT JOIN b USING (doc_id)), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a) SELECT *, NOT base_failed AND 100 * lost_words <= 50 * n_words AS kept FROM f"

# bytes as pairs of hexadecimal digits, in pieces so that no substring is far into a long text
OP7 = "WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), pc AS (SELECT doc_id, o, substr(h, 2 * o + 1, 4096) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, greatest(0, length(h) // 2 - 50), 1999)) AS o FROM b)), v AS MATERIALIZED (SELECT doc_id, o + k AS p, substr(s, 2 * k + 1, 100) AS x FROM (SELECT doc_id, o, s, unnest(generate_series(0, least(1998, length(s) // 2 - 50))) AS k FROM pc WHERE length(s) >= 100)), f AS (SELECT x, min(doc_id) AS d FROM v GROUP BY 1 HAVING count(*) > 1), hit AS MATERIALIZED (SELECT doc_id, p FROM v JOIN f USING (x) WHERE d < doc_id), run AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS n FROM hit)) GROUP BY doc_id, g), cut AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM (SELECT doc_id, h, e AS a, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY e), length(h) // 2) AS z FROM (SELECT b.doc_id, h, 0 AS s, 0 AS e FROM b UNION ALL SELECT run.doc_id, h, run.a, run.z FROM run JOIN b USING (doc_id))) GROUP BY 1) SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM b JOIN cut USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM run GROUP BY 1) USING (doc_id)"


def _grain(p: str) -> str:
    return f"(floor(log10({p}) * 4294967296::DOUBLE + 0.5) / 4294967296::DOUBLE)"


OP8 = (
    f"WITH d AS MATERIALIZED (SELECT doc_id, {CRC} % 5 = 1 AS held_out, list_concat([' s'], regexp_extract_all({SMALL}, {WORD}), [' e']) AS t FROM documents), "
    "u AS MATERIALIZED (SELECT doc_id, held_out, unnest(t) AS w, unnest(generate_series(0, len(t) - 1)) AS p FROM d), "
    "f AS MATERIALIZED (SELECT *, lag(w) OVER o AS v, lag(w, 2) OVER o AS x FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)), "
    "tr AS MATERIALIZED (SELECT * FROM f WHERE NOT held_out), "
    "c1 AS MATERIALIZED (SELECT w, count(*) AS c FROM tr WHERE p > 0 GROUP BY 1), nn AS MATERIALIZED (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v, (SELECT count(*) FROM d WHERE NOT held_out) AS docs FROM c1), "
    "h1 AS MATERIALIZED (SELECT w AS v, c AS cv FROM c1 UNION ALL SELECT ' s', docs FROM nn), "
    "c2 AS MATERIALIZED (SELECT v, w, count(*) AS c FROM tr WHERE p > 0 GROUP BY 1, 2), c3 AS MATERIALIZED (SELECT x, v, w, count(*) AS c FROM tr WHERE p > 1 GROUP BY 1, 2, 3), "
    "g AS (SELECT f.doc_id, f.held_out, f.p, coalesce(c1.c, 0) AS k1, coalesce(c2.c, 0) AS k2, coalesce(c3.c, 0) AS k3, coalesce(cv, 0) AS kv, coalesce(ch.c, 0) AS kh, (coalesce(c1.c, 0) + 0.5) / (n + 0.5 * (nn.v + 1))::DOUBLE AS p1 FROM f JOIN nn ON true LEFT JOIN c1 ON c1.w = f.w LEFT JOIN c2 ON c2.v = f.v AND c2.w = f.w LEFT JOIN c3 ON c3.x = f.x AND c3.v = f.v AND c3.w = f.w LEFT JOIN h1 ON h1.v = f.v LEFT JOIN c2 ch ON ch.v = f.x AND ch.w = f.v AND f.p > 1 WHERE f.p > 0), "
    "q AS (SELECT *, (k2 + 50.0::DOUBLE * p1) / (kv + 50.0::DOUBLE) AS p2 FROM g), "
    "s AS (SELECT *, (k3 + 50.0::DOUBLE * p2) / (kh + 50.0::DOUBLE) AS p3 FROM q) "
    f"SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (k1 > 0) AS n_known, (SELECT n FROM nn) AS train_tokens, sum({_grain('p1')}) AS base_score, "
    f"sum(CASE WHEN k3 > 0 THEN {_grain('p3')} ELSE (CASE WHEN kh > 0 THEN {_grain('50.0::DOUBLE / (kh + 50.0::DOUBLE)')} ELSE 0 END) + (CASE WHEN k2 > 0 THEN {_grain('p2')} ELSE (CASE WHEN kv > 0 THEN {_grain('50.0::DOUBLE / (kv + 50.0::DOUBLE)')} ELSE 0 END) + {_grain('p1')} END) END) AS score FROM s GROUP BY doc_id"
)

_W9 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP9 = f"WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({SMALL}, {_W9}) AS w FROM documents), bi AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({SMALL}, {_W9}) AS w FROM benchmark WHERE item_id IS NOT NULL), b AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS s FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM bi WHERE len(w) > 0)), z AS (SELECT DISTINCT n FROM b), v AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM w, z WHERE len(w) >= n)), h AS MATERIALIZED (SELECT DISTINCT doc_id, p, v.n, item FROM v JOIN b ON b.s = v.s AND b.n = v.n), c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS x FROM h) GROUP BY 1), i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1) SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"

OP10 = f"WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents), v AS MATERIALIZED (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM w WHERE len(w) > 12)), f AS (SELECT s, min(doc_id) AS d FROM v GROUP BY 1 HAVING count(*) > 1), g AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(generate_series(p, p + 12)) AS x FROM v JOIN f USING (s) WHERE d < doc_id)), k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.x) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS x FROM w) t LEFT JOIN g ON g.doc_id = t.doc_id AND g.x = t.x WHERE g.x IS NULL GROUP BY 1) SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) USING (doc_id)"

SQL = {"op2_minhash_dedup": OP2, "op6_quality_rules": OP6, "op7_suffix_dedup": OP7, "op8_lm_scores": OP8, "op9_decontamination": OP9, "op10_substring_dedup": OP10}
