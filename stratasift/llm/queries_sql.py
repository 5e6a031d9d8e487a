"""Queries of :mod:`stratasift.llm.queries` as SQL, where SQL can express them.

The other operators learn models, draw signatures or run a tokenizer; their tests compare
them with brute-force versions instead.
"""

from __future__ import annotations

import re

from stratasift.llm.secret_rules import BASE_KINDS, RULES


def _either_case(pattern: str) -> str:
    """The pattern with ASCII letters of its (?i:...) group in either case."""
    return re.sub(
        r"\(\?i:([^)]*)\)",
        lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")",
        pattern,
    )


def secrets() -> str:
    parts = []
    for order, rule in enumerate(RULES):
        p = _either_case(rule.pattern).replace("'", "''")
        parts.append(
            f"SELECT rid, {order} AS k, '{rule.kind}' AS kind, {rule.least} AS least,"
            f" regexp_extract_all(t, '{p}') AS f, regexp_extract_all(t, '{p}', {rule.group}) AS g,"
            f" string_split_regex(t, '{p}') AS s FROM d"
        )
    length = "list_transform({}, lambda x: length(x))"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    span = "kind || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
p AS (
  SELECT rid, k, kind, length(g[i]) >= least AS ok, length(f[i]) AS size,
         CAST(list_sum({length.format("s[1:i]")}) AS BIGINT)
         + coalesce(CAST(list_sum({length.format("f[1:i-1]")}) AS BIGINT), 0) AS a
  FROM i),
q AS (SELECT *, a + size AS b FROM p WHERE ok),
r AS (
  SELECT rid, {counts},
         string_agg({span}, ',' ORDER BY a, k) FILTER (kind IN ({base})) AS base,
         string_agg({span}, ',' ORDER BY a, k) AS spans
  FROM q GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (rid)"""


def fill_in_middle() -> str:
    draw = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
    form = "text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
c AS (SELECT *, len(u) AS n, {draw.format(1)} % (len(u) + 1) AS x, {draw.format(9)} % (len(u) + 1) AS y,
  CASE WHEN {form} OR {draw.format(17)} % 100 >= 90 THEN 'plain' WHEN {draw.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:least(x, y)], '') AS a,
  array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(u[greatest(x, y) + 1:], '') AS c FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
         ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(a || b || c) AS restored_sha256
FROM p"""


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def importance() -> str:
    upper = "".join(map(chr, range(65, 91)))
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    lowered = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    words = f"regexp_extract_all({lowered}, '{WORD}')"
    runs = "list_transform(range(1, len(w) + 1 - {n}), lambda i: array_to_string(w[i:i + {n}], ' '))"
    runs = f"list_concat(w, {runs.format(n=1)}, {runs.format(n=2)})"
    return f"""
WITH RECURSIVE t AS (
  SELECT x, list_reduce([CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step}) AS v
  FROM (SELECT unnest(range(256)) AS x)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
df AS MATERIALIZED (SELECT rid, f, count(*) AS n FROM (SELECT rid, unnest({runs}) AS f FROM d) GROUP BY ALL),
bf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({runs}) AS f FROM (SELECT {words} AS w FROM benchmark)) GROUP BY f),
u AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
r AS (
  SELECT f, h, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM u
  UNION ALL
  SELECT f, h, i + 2, xor(c >> 8, t.v)
  FROM r JOIN t ON t.x = xor(c & 255, CAST('0x' || substr(h, i, 2) AS BIGINT)) WHERE i < length(h)),
b AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS b FROM r WHERE i > length(h)),
s AS (SELECT b, sum(n) AS s FROM df JOIN b USING (f) GROUP BY b),
g AS (SELECT b, sum(n) AS t FROM bf JOIN b USING (f) GROUP BY b),
z AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) + 10000 AS DOUBLE) AS s, CAST(coalesce((SELECT sum(t) FROM g), 0) + 10000 AS DOUBLE) AS t),
gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(g.t, 0) + 1) * z.s / ((s.s + 1) * z.t))) AS BIGINT) AS gain
  FROM s LEFT JOIN g USING (b), z),
w AS (SELECT rid, sum(n) AS n, sum(n * gain) AS weight FROM df JOIN b USING (f) JOIN gain USING (b) GROUP BY rid),
x AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score,
         len(w) >= 20 AS able
  FROM d LEFT JOIN w USING (rid)),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY able) AS m FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= m * 5 // 100 THEN k END AS rank FROM k"""


SQL: dict[str, str] = {
    "op3_secrets": secrets(),
    "op11_fill_in_middle": fill_in_middle(),
    "op12_importance": importance(),
}
