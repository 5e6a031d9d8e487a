"""The queries of :mod:`stratasift.plans.table_queries` as SQL over the same tables.

The SQL follows the rules, not the DataFrame code: rows left over are dealt as
single units sorted by round and place, samples come from one row_number, and
merged statistics are computed from the base rows.
"""

from __future__ import annotations

DIGITS = 6
SEED = 7

ORDERS = ["o_orderpriority", "o_orderstatus"]
LINES = ["l_returnflag", "l_linestatus"]
DOCS = ["lang", "source"]


def joined(columns: list[str]) -> str:
    return ", ".join(columns)


def stratum(by: list[str]) -> str:
    return "concat_ws(',', " + joined([f"CAST({c} AS VARCHAR)" for c in by]) + ")"


def stats(source: str, by: list[str], value: str) -> str:
    return f"""
SELECT {joined(by)},
       round(avg(CAST({value} AS DOUBLE)), {DIGITS}) + 0.0 AS mean,
       round(stddev_pop(CAST({value} AS DOUBLE)), {DIGITS}) AS std,
       count({value}) AS n
FROM {source}
GROUP BY {joined(by)}"""


def allocation(
    source: str,
    by: list[str],
    value: str,
    budget: str,
    weight: str = "1.0",
    mean: str = "mean",
) -> str:
    """WITH-clause body ending in ``allocated``; ``budget`` may use ``rows`` and ``strata``."""
    return f"""
stats AS ({stats(source, by, value)}),
keyed AS (
  SELECT *, {stratum(by)} AS stratum,
         row_number() OVER (ORDER BY {stratum(by)}) - 1 AS place FROM stats),
total AS (
  SELECT CAST({budget} AS BIGINT) AS budget
  FROM (SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS strata FROM stats)),
gammas AS (SELECT *, sqrt({weight}) * (std / {mean}) AS gamma FROM keyed),
asked AS (
  SELECT g.*, budget, CAST(budget AS DOUBLE) * (gamma / gamma_sum) AS ask
  FROM gammas g, total, (SELECT sum(gamma) AS gamma_sum FROM gammas)),
wanted AS (
  SELECT *, CASE WHEN isnan(ask) THEN ask WHEN ask < 1 THEN 1.0 ELSE ask END AS want FROM asked),
based AS (
  SELECT *, CASE WHEN isnan(want) THEN 0
                 ELSE CAST(floor(least(want, CAST(n AS DOUBLE))) AS BIGINT) END AS base
  FROM wanted),
spared AS (
  SELECT b.*, want - base AS rest, spare
  FROM based b, (SELECT CAST(max(budget) - sum(base) AS BIGINT) AS spare FROM based)),
ordered AS (
  SELECT *, CASE WHEN spare > 0 THEN row_number() OVER (ORDER BY rest DESC, stratum DESC)
                 ELSE row_number() OVER (ORDER BY rest, stratum) END AS turn,
         CASE WHEN spare > 0 THEN n - base ELSE greatest(base - 1, 0) END AS h
  FROM spared),
units AS (
  SELECT stratum, turn, abs(spare) AS need, unnest(range(1, least(h, abs(spare)) + 1)) AS round
  FROM ordered),
moved AS (
  SELECT stratum, count(*) AS units
  FROM (SELECT *, row_number() OVER (ORDER BY round, turn) AS unit FROM units)
  WHERE unit <= need GROUP BY stratum),
allocated AS (
  SELECT o.*, CAST(base + sign(spare) * coalesce(units, 0) AS BIGINT) AS si
  FROM ordered o LEFT JOIN moved USING (stratum))"""


def allocate(source: str, by: list[str], value: str, budget: str, **options: str) -> str:
    return f"""WITH {allocation(source, by, value, budget, **options)}
SELECT {joined(by)}, mean, std, n, si FROM allocated"""


def sampling(source: str, by: list[str], value: str, budget: str, ids: list[str]) -> str:
    """WITH-clause body ending in ``allocated`` and ``sampled``."""
    text = f"concat_ws(':', '{SEED}', " + joined([f"CAST(d.{c} AS VARCHAR)" for c in ids]) + ")"
    groups = joined([f"d.{c}" for c in by])
    order = joined([f"substr(md5({text}), 1, 13)", *[f"d.{c}" for c in ids]])
    return f"""{allocation(source, by, value, budget)},
sampled AS (
  SELECT * FROM (
    SELECT d.*, a.mean, a.std, a.n, a.si, a.stratum,
           row_number() OVER (PARTITION BY {groups} ORDER BY {order}) AS place_in_stratum
    FROM {source} d JOIN allocated a USING ({joined(by)}))
  WHERE place_in_stratum <= si)"""


def sample(
    source: str, by: list[str], value: str, budget: str, ids: list[str], columns: list[str]
) -> str:
    return f"""WITH {sampling(source, by, value, budget, ids)}
SELECT {joined(columns)} FROM sampled"""


def report(source: str, by: list[str], value: str, budget: str, ids: list[str]) -> str:
    return f"""WITH {sampling(source, by, value, budget, ids)}
SELECT {joined(by)}, any_value(mean) AS mean, any_value(std) AS std, any_value(n) AS n,
       any_value(si) AS si, count(*) AS sample_n,
       round(avg(CAST({value} AS DOUBLE)), {DIGITS}) AS sample_mean,
       round(stddev_pop(CAST({value} AS DOUBLE)), {DIGITS}) AS sample_std
FROM sampled GROUP BY {joined(by)}"""


ORDERS_SAMPLE = ("orders", ORDERS, "o_totalprice", "rows // 30", ["o_orderkey"])
EVENTS_SAMPLE = ("events", ["event_type"], "value", "rows // 20", ["event_id"])
DOCS_SAMPLE = ("documents", DOCS, "n_chars", "rows // 2", ["doc_id"])

EVENTS_OUT = ["event_type", "event_id", "value"]
DOCS_OUT = [*DOCS, "doc_id", "text", "CAST(n_chars AS DOUBLE) AS n_chars"]

COPIES = f"""(
  SELECT {joined(LINES)}, l_quantity,
         row_number() OVER (PARTITION BY {joined(LINES)}, l_quantity) AS copy_no
  FROM lineitem)"""

KEPT_COPIES = COPIES.replace("l_quantity", "l_quantity, l_linenumber")

CLEAN_EVENTS = "(SELECT * FROM events WHERE event_type <> 'error' AND value <= 400)"


def report_lines() -> str:
    fixed = f"DECIMAL(38, {DIGITS})"

    def text(number: str) -> str:
        return f"CAST(CAST({number} AS {fixed}) AS VARCHAR)"

    fields = [
        "stratum", text("mean"), text("std"), "CAST(n AS VARCHAR)", "CAST(si AS VARCHAR)",
        "CAST(sample_n AS VARCHAR)", text("sample_mean"), text("sample_std"),
    ]
    return f"""WITH {sampling(*ORDERS_SAMPLE)},
figures AS (
  SELECT stratum, any_value(mean) AS mean, any_value(std) AS std, any_value(n) AS n,
         any_value(si) AS si, count(*) AS sample_n, avg(o_totalprice) AS sample_mean,
         stddev_pop(o_totalprice) AS sample_std
  FROM sampled GROUP BY stratum)
SELECT stratum, CAST(0 AS INTEGER) AS part, concat_ws(', ', {joined(fields)}) || ', ' AS line
FROM figures
UNION ALL
SELECT stratum, CAST(1 AS INTEGER), concat_ws(', ', o_orderpriority, o_orderstatus, {text("o_totalprice")})
FROM sampled
UNION ALL
SELECT stratum, CAST(2 AS INTEGER), '' FROM figures"""


SQL: dict[str, str] = {
    "stratum_stats_orders": stats("orders", ORDERS, "o_totalprice"),
    "stratum_stats_events": stats("events", ["event_type"], "value"),
    "stratum_stats_lineitem": stats("lineitem", LINES, "l_extendedprice"),
    "stratum_stats_lineitem_supplier": stats("lineitem", [*LINES, "l_suppkey"], "l_quantity"),
    "stratum_key_parts": f"""SELECT {stratum(["p_brand", "p_type"])} AS stratum, mean, std, n
FROM ({stats("part", ["p_brand", "p_type"], "p_retailprice")})""",
    "stratum_stats_clean_csv": f"""SELECT event_type AS kind, mean, std, n
FROM ({stats(CLEAN_EVENTS, ["event_type"], "value")})""",
    "rejected_csv": """SELECT event_id, event_type AS kind, 'n/a' AS amount
FROM events WHERE event_type <> 'error' AND value > 400""",
    "clean_documents_csv": """SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS n_chars,
       md5(text) AS text_md5 FROM documents""",
    "csv_file_stats_events": stats("events", ["event_type"], "value"),
    "latest_stats_events": f"""
SELECT *, CAST(2 AS BIGINT) AS version
FROM ({stats("events", ["event_type"], "value")}) WHERE event_type <> 'signup'
UNION ALL
SELECT *, CAST(1 AS BIGINT)
FROM ({stats("(SELECT * REPLACE (value / 2 AS value) FROM events)", ["event_type"], "value")})
WHERE event_type = 'signup'""",
    "merge_stats_lineitem": stats("lineitem", LINES, "l_extendedprice"),
    "stats_records_orders": f"""SELECT {stratum(ORDERS)} AS stratum, mean, std, n
FROM ({stats("orders", ORDERS, "o_totalprice")})""",
    "share_orders": f"""WITH s AS ({stats("orders", ORDERS, "o_totalprice")})
SELECT {joined(ORDERS)}, mean, std, n, round(std / mean, 9) AS gamma,
       round((std / mean) / (SELECT sum(std / mean) FROM s), 9) AS share
FROM s""",
    "totals_documents": f"""
SELECT count(*) AS strata, CAST(sum(n) AS BIGINT) AS rows,
       round(sum(sqrt(length(lang)) * (std / mean)), 6) AS gamma
FROM ({stats("documents", DOCS, "n_chars")})""",
    "allocate_documents_give": allocate("documents", DOCS, "n_chars", "rows // 2"),
    "allocate_documents_take": allocate(
        "documents", DOCS, "n_chars", "strata + 1",
        weight="CASE WHEN lang = 'en' THEN 0.0 ELSE 4.0 END",
    ),
    "allocate_weight_list": allocate(
        "documents", DOCS, "n_chars", "rows // 4",
        weight="CASE WHEN place % 5 = 0 THEN 1.0 ELSE CAST(place % 5 - 1 AS DOUBLE) END",
    ),
    "allocate_degenerate": allocate(
        "(SELECT *, 1.0 AS one FROM documents)", DOCS, "one", "rows * 3 // 5"
    ),
    "allocate_zero_strata": allocate(
        "(SELECT *, CASE WHEN lang = 'de' THEN 0.0 ELSE CAST(n_chars AS DOUBLE) END AS v"
        " FROM documents)", DOCS, "v", "rows * 3 // 5",
    ),
    "allocate_infinite_share": allocate(
        f"""(SELECT *, o_totalprice - CASE WHEN o_orderstatus = 'P'
             THEN avg(o_totalprice) OVER (PARTITION BY {joined(ORDERS)}) ELSE 0.0 END AS v
             FROM orders)""",
        ORDERS, "v", "rows // 30",
    ),
    "allocate_signed": allocate(
        "(SELECT *, c_acctbal - 4500 AS v FROM customer)", ["c_nationkey"], "v", "rows * 2 // 15"
    ),
    "allocate_abs": allocate(
        "(SELECT *, c_acctbal - 4500 AS v FROM customer)", ["c_nationkey"], "v",
        "rows * 2 // 15", mean="abs(mean)",
    ),
    "allocate_parts": allocate("part", ["p_brand", "p_type"], "p_retailprice", "rows // 2"),
    "allocate_lineitem_supplier": allocate(
        "lineitem", ["l_suppkey"], "l_extendedprice", "rows // 20"
    ),
    "stratified_sample_orders": sample(
        *ORDERS_SAMPLE, [*ORDERS, "o_orderkey", "o_totalprice"]
    ),
    "stratified_sample_orders_fast": f"""WITH {allocation(*ORDERS_SAMPLE[:4])}
SELECT {joined(ORDERS)}, si AS rows, si AS orders FROM allocated""",
    "stratified_sample_lineitem_keep": sample(
        KEPT_COPIES, LINES, "l_quantity", "rows // 60",
        [*LINES, "l_quantity", "l_linenumber", "copy_no"],
        [*LINES, "l_quantity", "l_linenumber", "copy_no"],
    ),
    "stratified_sample_events": sample(*EVENTS_SAMPLE, EVENTS_OUT),
    "stratified_sample_documents": sample(*DOCS_SAMPLE, DOCS_OUT),
    "stratified_sample_lineitem": sample(
        COPIES, LINES, "l_quantity", "rows // 60", [*LINES, "l_quantity", "copy_no"],
        [*LINES, "l_quantity", "copy_no"],
    ),
    "skip_sample_events": sample(*EVENTS_SAMPLE, EVENTS_OUT),
    "skip_sample_documents": sample(*DOCS_SAMPLE, DOCS_OUT),
    "number_copies_lineitem": f"SELECT * FROM {COPIES}",
    "sample_report_orders": report(*ORDERS_SAMPLE),
    "sample_report_documents": report(*DOCS_SAMPLE),
    "nested_report_documents": f"""WITH {sampling(*DOCS_SAMPLE)}
SELECT lang, source, any_value(n) AS n, any_value(si) AS si, count(*) AS sample_n,
       string_agg(CAST(n_chars AS VARCHAR), ',' ORDER BY n_chars) AS sample_values
FROM sampled GROUP BY lang, source""",
    "nested_report_orders": f"""WITH {sampling(*ORDERS_SAMPLE)},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY {joined(ORDERS)} ORDER BY o_totalprice) - 1 AS pos,
         count(*) OVER (PARTITION BY {joined(ORDERS)}) AS sample_n FROM sampled)
SELECT {joined(ORDERS)}, sample_n, CAST(pos // 10 AS BIGINT) AS chunk,
       CAST(count(*) AS INTEGER) AS n_values, min(o_totalprice) AS lowest, max(o_totalprice) AS highest
FROM placed GROUP BY {joined(ORDERS)}, sample_n, pos // 10""",
    "report_lines_orders": report_lines(),
    "topic_records_events": """
SELECT lpad(printf('%x', place), 16, '0') AS key_hex, place AS key,
       CAST(place % 4 AS INTEGER) AS partition, value
FROM (SELECT row_number() OVER (ORDER BY event_id) AS place,
             concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(value AS VARCHAR), props)
               AS value
      FROM events)""",
    "topic_stats_events": f"""SELECT partition, kind, mean, std, n FROM ({stats(
        '''(SELECT CAST((event_id + 1) % 4 AS INTEGER) AS partition, event_type AS kind, value
            FROM events)''', ["partition", "kind"], "value")})""",
    "stream_stats_events": stats("events", ["event_type"], "value"),
    "stream_sample_events": sample(*EVENTS_SAMPLE, EVENTS_OUT),
    "stream_report_events": report(*EVENTS_SAMPLE),
    "idle_publish_events": stats("events", ["event_type"], "value"),
    "idle_emit_events": stats("events", ["event_type"], "value"),
    "jump_sample_orders": f"""
SELECT {joined(ORDERS)}, si, si AS drawn, si AS different, CAST(0 AS BIGINT) AS strays
FROM ({allocate("orders", ORDERS, "o_totalprice", "rows // 10")})""",
    "stream_reservoir_events": sample(*EVENTS_SAMPLE, EVENTS_OUT),
    "stream_two_phase_events": report(*EVENTS_SAMPLE),
    "stream_allocation_events": allocate("events", ["event_type"], "value", "rows // 20"),
}
SQL["position_sample_orders"] = SQL["jump_sample_orders"]
SQL["stream_latest_stats_events"] = SQL["latest_stats_events"]
