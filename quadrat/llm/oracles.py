"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from quadrat.llm.ngram_join import PERCENT
from quadrat.llm.quality_rules import BUCKETS, MULTIPLIERS, SMOOTHING, THRESHOLD

_WORD = r"[^\x20\x09-\x0D]+"


def _step(h: str, code: str, multiplier: int) -> str:
    product = f"((xor({h}, {code}) * {multiplier}::UBIGINT) & 4294967295::UBIGINT)"
    return f"xor({product}, {product} >> 15)"


OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
win AS (SELECT row, k, array_to_string(ws[k:k + 7], ' ') AS x FROM (SELECT row, ws, UNNEST(range(1, len(ws) - 6)) AS k FROM w WHERE len(ws) >= 9)),
rep AS (SELECT row, UNNEST(range(k, k + 8)) AS k FROM (SELECT row, k, COUNT(*) OVER (PARTITION BY row, x) AS n FROM win) WHERE n > 1),
reps AS (SELECT row, COUNT(DISTINCT k) AS n FROM rep GROUP BY 1),
lines AS (SELECT row, COUNT(*) - COUNT(DISTINCT line) AS n FROM (SELECT row, UNNEST(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
codes AS (SELECT row, list_transform(string_split(t, ''), lambda x: unicode(x)::UBIGINT) AS cs FROM d WHERE length(t) >= 3),
grams AS (SELECT row, cs[k] AS c0, cs[k + 1] AS c1, cs[k + 2] AS c2 FROM (SELECT row, cs, UNNEST(range(1, len(cs) - 1)) AS k FROM codes)),
g0 AS (SELECT row, c1, c2, {_step("0::UBIGINT", "c0", int(MULTIPLIERS[0]))} AS h0 FROM grams), g1 AS (SELECT row, c2, {_step("h0", "c1", int(MULTIPLIERS[1]))} AS h1 FROM g0),
g2 AS (SELECT row, ({_step("h1", "c2", int(MULTIPLIERS[2]))}) % {BUCKETS} AS b FROM g1), per AS (SELECT row, b, COUNT(*) AS n FROM g2 GROUP BY 1, 2),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING MIN(quality) = 1),
counts AS (SELECT b, SUM(n) AS raw, COALESCE(SUM(n) FILTER (doc_id IN (SELECT doc_id FROM good)), 0) AS target FROM per JOIN d USING (row) GROUP BY 1), sums AS (SELECT SUM(raw) AS r, SUM(target) AS t FROM counts),
ratio AS (SELECT b, ln((target + {SMOOTHING}) / (t + {SMOOTHING * BUCKETS})) - ln((raw + {SMOOTHING}) / (r + {SMOOTHING * BUCKETS})) AS v FROM counts, sums),
mean AS (SELECT row, SUM(n * v) / SUM(n) AS m FROM per JOIN ratio USING (b) GROUP BY 1),
base AS (SELECT row, doc_id, len(ws)::BIGINT AS n_words, COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, COALESCE(lines.n, 0)::BIGINT AS n_dup_lines, COALESCE(reps.n, 0)::BIGINT AS n_repeat_words,
n_words < 20 OR 100 * COALESCE(reps.n, 0) > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * COALESCE(reps.n, 0) > 30 * n_words) AND COALESCE(m, 0) >= {THRESHOLD} AS kept
FROM base LEFT JOIN reps USING (row) LEFT JOIN lines USING (row) LEFT JOIN mean USING (row)
"""

OP5 = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS b FROM pages), h AS (SELECT page_id, strlen(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
l AS (SELECT *, MAX(page_id) OVER (PARTITION BY x, payload_bytes) AS last FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM l
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS z FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 2], ' ') AS g FROM (SELECT doc_id, ws, UNNEST(range(1, GREATEST(len(ws) - 1, 2))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * i >= {PERCENT} * (nx.n + ny.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x)
SELECT w.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, MIN(y) AS c FROM reach GROUP BY 1) USING (doc_id)
"""


def _crc(of: str, longest: str) -> str:
    """Named tables that end in crc(x, h): the crc32 of every text x of the table ``of``, as one sum of what each byte adds at its distance from the end."""
    return f"""
byte_steps AS (SELECT b, 0 AS k, b::UBIGINT AS v FROM range(256) AS r(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM byte_steps WHERE k < 8),
byte_table AS (SELECT list(v ORDER BY b) AS t FROM byte_steps WHERE k = 8),
at_end AS (SELECT b, 0 AS k, v FROM byte_steps WHERE k = 8 UNION ALL SELECT b, k + 1, xor(v >> 8, t[(v & 255)::BIGINT + 1]) FROM at_end, byte_table WHERE k < {longest}),
adds AS MATERIALIZED (SELECT k, v, printf('%02X', b) AS hx FROM at_end),
starts AS (SELECT 0 AS n, 4294967295::UBIGINT AS s UNION ALL SELECT n + 1, xor(s >> 8, t[(s & 255)::BIGINT + 1]) FROM starts, byte_table WHERE n <= {longest}),
bytes AS (SELECT x, n, substr(hx, 2 * i + 1, 2) AS hx, n - 1 - i AS k FROM (SELECT x, n, hx, UNNEST(range(n)) AS i FROM (SELECT x, strlen(x) AS n, hex(encode(x)) AS hx FROM {of}))),
crc AS (SELECT x, xor(4294967295::UBIGINT, xor(ANY_VALUE(s), bit_xor(v))) AS h FROM bytes JOIN adds USING (k, hx) JOIN starts USING (n) GROUP BY x)"""


_LOWERED = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, w, COUNT(*) AS n FROM (SELECT doc_id, UNNEST(regexp_extract_all({_LOWERED}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents) GROUP BY 1, 2),
keys AS (SELECT doc_id, w, n, doc_id || ':' || w AS x FROM runs), longest AS (SELECT max(strlen(x)) AS m FROM keys), texts AS (SELECT DISTINCT x FROM keys), {_crc("texts", "(SELECT m FROM longest)")},
noisy AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w FROM keys JOIN crc USING (x)),
v AS MATERIALIZED (SELECT w, SUM(n)::BIGINT AS n FROM noisy WHERE length(w) >= 6 GROUP BY 1 HAVING SUM(n) >= 5),
cut AS MATERIALIZED (SELECT w, n, p, substr(w, 1, p) || substr(w, p + 2) AS c FROM (SELECT w, n, UNNEST(range(length(w))) AS p FROM v)),
near AS (SELECT a.w, b.w AS u, b.n AS m FROM cut AS a JOIN cut AS b ON a.c = b.c AND a.p = b.p AND a.w <> b.w UNION SELECT a.w, b.w, b.n FROM cut AS a JOIN v AS b ON a.c = b.w UNION SELECT b.w, a.w, a.n FROM cut AS a JOIN v AS b ON a.c = b.w),
best AS (SELECT w, COUNT(*) AS k, MIN((-m, u)) AS x FROM near GROUP BY 1),
formed AS MATERIALIZED (SELECT v.w, v.n, COALESCE(k, 0)::BIGINT AS k, CASE WHEN -x[1] >= 5 * v.n THEN x[2] END AS form, CASE WHEN -x[1] >= 5 * v.n THEN -x[1] END AS form_n FROM v LEFT JOIN best USING (w)),
path AS (SELECT w, w AS r FROM formed UNION ALL SELECT path.w, f.form FROM path JOIN formed AS f ON f.w = path.r WHERE f.form IS NOT NULL),
ends AS (SELECT path.w, path.r FROM path JOIN formed AS f ON f.w = path.r WHERE f.form IS NULL)
SELECT w AS word, form, r AS root, n, k AS n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (w)
"""

_GRAM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP12 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '{_GRAM}') AS ws FROM documents),
b AS (SELECT -row_number() OVER () AS row, regexp_extract_all({_LOWERED}, '{_GRAM}') AS ws FROM benchmark), both_ AS (SELECT row, ws FROM d UNION ALL SELECT row, ws FROM b),
f AS MATERIALIZED (SELECT row, x, COUNT(*) AS n FROM (SELECT row, array_to_string(ws[k:k + r], ' ') AS x FROM (SELECT row, ws, r, UNNEST(range(1, len(ws) - r + 1)) AS k FROM both_, range(3) AS s(r) WHERE len(ws) > r)) GROUP BY 1, 2),
longest AS (SELECT max(strlen(x)) AS m FROM f), texts AS (SELECT DISTINCT x FROM f), {_crc("texts", "(SELECT m FROM longest)")},
p AS MATERIALIZED (SELECT row, h % 10000 AS bucket, SUM(n) AS n FROM f JOIN crc USING (x) GROUP BY 1, 2),
c AS (SELECT bucket, COALESCE(SUM(n) FILTER (row > 0), 0)::DOUBLE AS s, COALESCE(SUM(n) FILTER (row < 0), 0)::DOUBLE AS t FROM p GROUP BY 1), sums AS (SELECT SUM(s) AS ss, SUM(t) AS tt FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS gain FROM c, sums),
w AS (SELECT row, SUM(n)::BIGINT AS n_features, SUM(n * gain)::BIGINT AS weight FROM p JOIN g USING (bucket) WHERE row > 0 GROUP BY 1),
e AS (SELECT doc_id, len(ws) AS n_words, COALESCE(n_features, 0)::BIGINT AS n_features, COALESCE(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (row)),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS k, COUNT(*) FILTER (n_words >= 20) OVER () AS total FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * total // 100 THEN k END AS rank FROM o
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op5_warc": OP5, "op6_topk_search": OP6, "op9_ngram_join": OP9, "op11_spelling_variants": OP11, "op12_importance_resampling": OP12}
