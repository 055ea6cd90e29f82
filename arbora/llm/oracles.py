"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .chat import CLOSE, LEARNT, MIDDLE, OPEN
from .mixing import BLOCK_WORDS, GOLDEN, LEAST_BLOCKS, REPEATS, SPAN, WORD
from .pii import BASE as PII_BASE
from .pii import CONTEXT, RAISE, REACH, SCORES
from .pii import PATTERNS as PII_PATTERNS
from .secrets import BASE as SECRET_BASE
from .secrets import RULES as SECRET_RULES
from .url_rules import DEFAULT, RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""

_OP3 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.row, q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.row <> d.row WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 5
"""


def _found(kind: str, pattern: str) -> str:
    """A list of structs (kind, s, e, m) of a pattern's matches in t, with code point places."""
    m, g = f"regexp_extract_all(t, {_quote(pattern)})", f"string_split_regex(t, {_quote(pattern)})"
    n = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda z: length(z))), 0)"
    at = f"({n(f'{g}[1:i]')} + {n(f'{m}[1:i-1]')})::BIGINT"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'kind': '{kind}', 's': {at}, 'e': {at} + length({m}[i]), 'm': {m}[i]}})"


def _joined(xs: str) -> str:
    return f"coalesce(array_to_string(list_transform({xs}, lambda z: concat(z.kind, ':', z.s, ':', z.e)), ','), '')"


def _secrets() -> str:
    each = []
    for k, r in enumerate(SECRET_RULES):
        keep = f"length(regexp_extract(z.m, {_quote(r.pattern)}, {r.value})) >= {r.least}" if r.least else "true"
        pattern = r.pattern.replace("}+", "}")
        each.append(f"list_transform(list_filter({_found(r.kind, pattern)}, lambda z: {keep}), lambda z: {{'s': z.s, 'k': {k}, 'e': z.e, 'kind': z.kind}})")
    kinds = ", ".join(_quote(r.kind) for r in SECRET_BASE)
    counts = ", ".join(f"len(list_filter(x, lambda z: z.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in SECRET_BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(list_concat({", ".join(each)})) AS x FROM d)
SELECT doc_id, {counts}, sha256({_joined(f"list_filter(x, lambda z: z.kind IN ({kinds}))")}) AS base_sha256, {_joined("x")} AS spans FROM f
"""


def _pii() -> str:
    digits = "regexp_replace(z.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN (length({digits}) - j) % 2 = 0 THEN substr({digits}, j::INT, 1)::INT ELSE (substr({digits}, j::INT, 1)::INT * 2) % 10 + substr({digits}, j::INT, 1)::INT // 5 END)) % 10 = 0"
    iban = "replace(z.m, ' ', '')"
    number = f"array_to_string(list_transform(string_split(concat(substr({iban}, 5), substr({iban}, 1, 4)), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')"
    keep = {
        "ip": r"len(list_filter(string_split(z.m, '.'), lambda p: NOT regexp_matches(p, '^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$'))) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({number}, ''), lambda c: c::INT)), lambda a, b: (a * 10 + b) % 97) = 1",
    }
    patterns = PII_PATTERNS | {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
    }
    each = [f"list_filter({_found(k, p)}, lambda z: {keep.get(k, 'true')})" for k, p in patterns.items()]
    near = f"translate(concat(substr(t, greatest(z.s - {REACH}, 0) + 1, z.s - greatest(z.s - {REACH}, 0)), ' ', substr(t, z.e + 1, {REACH})), '{_UP}', '{_LOW}')"
    score = "CASE z.kind " + " ".join(f"WHEN '{k}' THEN least(100, {SCORES[k]} + CASE WHEN regexp_matches({near}, '{CONTEXT[k]}') THEN {RAISE} ELSE 0 END)" for k in PII_PATTERNS) + " END"
    counts = ", ".join(f"len(list_filter(x, lambda z: z.kind = '{k}'))::BIGINT AS n_{k}" for k in PII_BASE)
    kinds = ", ".join(map(_quote, PII_BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, t, list_concat({", ".join(each)}) AS x FROM d)
SELECT doc_id, {counts}, sha256({_joined(f"list_filter(x, lambda z: z.kind IN ({kinds}))")}) AS base_sha256, {_joined("x")} AS spans,
  coalesce(array_to_string(list_transform(x, lambda z: ({score})::VARCHAR), ','), '') AS scores FROM f
"""


_OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s0),
s2 AS (SELECT *, (no - 1) % 3 + 1 AS w, {REPEATS} * source_size AS cap, sum(source_size) OVER () AS total FROM s1),
s3 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c,
    sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest FROM s2),
s4 AS (SELECT *, cap::HUGEINT * rest <= w * (total - c) AS capped FROM s3),
s5 AS (
  SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE w::DOUBLE * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
    / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target,
    greatest((source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}, least(source_size, {LEAST_BLOCKS}))::BIGINT AS blocks FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * blocks / source_size + 0.5)::BIGINT ELSE 0 END AS slots FROM s5),
s7 AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, sum(slots) OVER ()::HUGEINT AS every FROM s6),
plan AS (SELECT *, before * {SPAN} // greatest(every, 1) AS lo, (before + slots) * {SPAN} // greatest(every, 1) AS hi FROM s7),
points AS (SELECT i AS slot, (i::HUGEINT * {GOLDEN}) % {SPAN} AS point FROM range((SELECT coalesce(sum(slots), 0)::BIGINT FROM plan)) t(i)),
ranked AS (SELECT no, blocks, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS r FROM points JOIN plan ON point >= lo AND point < hi),
times AS (SELECT no, r % blocks AS block, count(*) AS times FROM ranked WHERE r // blocks < {REPEATS} GROUP BY ALL),
place AS (
  SELECT d.row, d.doc_id, d.size, p.no, p.source_size, p.target, p.blocks, coalesce(sum(d.size) OVER (PARTITION BY p.no
    ORDER BY d.doc_id IS NULL, md5(coalesce(d.doc_id::VARCHAR, '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS start
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
pieces AS (
  SELECT *, unnest(range((((start + 1) * blocks - 1) // source_size)::BIGINT, (((start + size) * blocks - 1) // source_size)::BIGINT + 1)) AS block
  FROM place WHERE size > 0),
taken AS (
  SELECT row, sum((least(start + size, (block + 1)::HUGEINT * source_size // blocks) - greatest(start, block::HUGEINT * source_size // blocks)) * times) AS taken
  FROM pieces JOIN times USING (no, block) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM place LEFT JOIN taken USING (row)
"""


_RULES = ", ".join(f"({_quote(h)}, {_quote(p)}, {_quote(v)})" for h, p, v in RULES)
_OP8 = rf"""
WITH u AS (
  SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES {_RULES}),
f AS (
  SELECT row, h || p AS rule, v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC, h || p) = 1)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM u LEFT JOIN f USING (row)
"""


def _turns(xs: str) -> str:
    return f"coalesce(array_to_string(list_transform({xs}, lambda z: concat('{OPEN}', z.role, {_quote(MIDDLE)}, z.text, {_quote(CLOSE)})), ''), '')"


def _learnt(xs: str) -> str:
    size = f"(length(y.role) + length(y.text) + {len(OPEN) + len(MIDDLE) + len(CLOSE)})"
    end = f"list_sum(list_transform({xs}[1:i], lambda y: {size}))"
    return f"coalesce(array_to_string(list_transform(list_filter(range(1, len({xs}) + 1), lambda i: {xs}[i].role = '{LEARNT}'), lambda i: concat({end} - length({xs}[i].text) - {len(CLOSE)}, ':', {end})), ','), '')"


_OP9 = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS t FROM t GROUP BY conv_id),
p AS (SELECT a.conv_id // 2 AS pair_id, a.t AS a, b.t AS b FROM c a JOIN c b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1),
n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n FROM p),
r AS (SELECT pair_id, n, a[1:n] AS h, a[n+1:] AS a, b[n+1:] AS b FROM n)
SELECT pair_id::BIGINT AS pair_id, n::BIGINT AS prompt_turns, {_turns("h")} AS prompt, {_turns("a")} AS chosen, {_turns("b")} AS rejected,
  {_learnt("a")} AS chosen_spans, {_learnt("b")} AS rejected_spans FROM r
"""

ORACLES: dict[str, str] = {
    "op1_near_dedup": _OP1,
    "op3_topk": _OP3,
    "op5_secrets": _secrets(),
    "op6_mixing": _OP6,
    "op7_pii": _pii(),
    "op8_url_rules": _OP8,
    "op9_preference": _OP9,
}
