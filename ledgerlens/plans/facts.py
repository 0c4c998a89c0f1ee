"""Queries over annual financial facts (M), ratios and rules on them (X07, X11, X13), exact in decimals, and their SQL."""

from __future__ import annotations

from ..functions.text import sha256
from ..sources.tables import FACTS, TOP_CUSTOMERS
from .stages import Query, Stage, over, stage

TABLES = ("lineitem", "supplier", "nation")
BY = over(by="stock_code", order="report_year")


def pct(num: str, den: str, digits: int = 2) -> str:
    """num / den in per cent, half up, NULL unless den is positive."""
    return f"CASE WHEN {den} > 0 THEN CAST(round(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100, {digits + 4}) AS DOUBLE) END"


CHANGES: tuple[Stage, ...] = (
    stage(**{f"p_{m}": f"lag({m}) {BY}" for m in ("revenue", "net_profit", "operating_cash_flow")}, gap=f"report_year - lag(report_year) {BY}"),
    stage(**{f"g_{m}": f"CASE WHEN gap = 1 THEN {pct(f'({m} - p_{m})', f'p_{m}')} END" for m in ("revenue", "net_profit", "operating_cash_flow")}),
)
CASH: tuple[Stage, ...] = (stage(cash_ratio=pct("operating_cash_flow", "net_profit")), stage(weak="cash_ratio < 50"), stage(was_weak=f"lag(weak) {BY}"))

#: A long table: one row per filed value of a company, year and metric, with what admission checks. A company whose
#: lines are partly returned files that year twice, before and after restatement, so values may conflict.
_FILED = ("revenue", "net_profit", "operating_cash_flow", "inventory", "receivables")
_ROWS = ", ".join(f"'{m}'" for m in _FILED), ", ".join(_FILED)
LONG = tuple(
    f"""SELECT stock_code, report_year, metric_key, value, 'CNY' AS currency, CASE WHEN value = 0 THEN NULL ELSE 'consolidated' END AS value_basis, filing FROM (
SELECT stock_code, report_year, {unpivot}, 'annual' AS filing FROM ({FACTS}) f
UNION ALL SELECT stock_code, report_year, 'revenue', CAST(revenue - subsidies AS DECIMAL(24,2)), 'restated' FROM ({FACTS}) g WHERE subsidies * 80 > revenue) u"""
    for unpivot in (
        f"stack({len(_FILED)}, {', '.join(f"'{m}', {m}" for m in _FILED)}) AS (metric_key, value)",
        f"unnest([{_ROWS[0]}]) AS metric_key, unnest([{_ROWS[1]}]) AS value",
    )
)
#: Admitted series: a year with more than one distinct value of a metric is left out and told.
SERIES = """SELECT stock_code, report_year, metric_key, min(value) AS value, count(DISTINCT value) AS bodies FROM t GROUP BY stock_code, report_year, metric_key"""
ADMITTED: tuple[Stage, ...] = (
    stage(reject_code="CASE WHEN metric_key NOT IN ('revenue', 'net_profit', 'operating_cash_flow') THEN 'unsupported_metric_key' WHEN report_year < 1990 OR report_year > 2100 THEN 'invalid_report_year' WHEN value_basis IS NULL THEN 'missing_value_basis' WHEN value IS NULL THEN 'invalid_normalized_value' END"),
)


def facts(stages, *select: str, where=None, final=None) -> Query:
    return Query(FACTS, tuple(stages), ("stock_code", "CAST(report_year AS INT) AS report_year", *select), where, final, TABLES)


def long(stages, *select: str, where=None, final=None) -> Query:
    return Query(LONG, tuple(stages), ("stock_code", "CAST(report_year AS INT) AS report_year", "metric_key", *select), where, final, TABLES)


def dbl(*cols: str) -> tuple[str, ...]:
    return tuple(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)


ADMITTED_ONLY = (*ADMITTED, stage(where="reject_code IS NULL"))
#: What is hashed of a year's record, and the store of an earlier run: some records older, some damaged, some missing.
BODY = "concat_ws('|', stock_code, CAST(CAST(report_year AS INT) AS VARCHAR(9)), CAST(revenue AS VARCHAR(40)), CAST(net_profit AS VARCHAR(40)), CAST(operating_cash_flow AS VARCHAR(40)))"
_OLD_BODY = BODY.replace("CAST(revenue AS", "CAST(CASE WHEN subsidies * 80 > revenue THEN CAST(revenue - subsidies AS DECIMAL(24,2)) ELSE revenue END AS")
STORED = tuple(
    f"""SELECT f.*, s.stored_hash, s.stored_actual FROM ({FACTS}) f LEFT JOIN (
SELECT stock_code AS s_code, report_year AS s_year, {h} AS stored_actual, CASE WHEN impairment = 0 THEN concat('0', substr({h}, 2)) ELSE {h} END AS stored_hash
FROM ({FACTS}) g WHERE acquisitions > 0) s ON f.stock_code = s.s_code AND f.report_year = s.s_year"""
    for h in sha256(_OLD_BODY)
)
#: What others report of a company's revenue: rounded values of the year and ranges of the year before or after.
EXTERNAL = f"""WITH f AS ({FACTS}),
o AS (SELECT stock_code, report_year, 'value' AS kind, 5 AS digits, round(CAST(revenue AS DOUBLE), -5) AS lo, CAST(NULL AS DOUBLE) AS hi FROM f
  UNION ALL SELECT stock_code, report_year + 1, 'range', 0, CAST(revenue AS DOUBLE) * 0.97, CAST(revenue AS DOUBLE) * 1.03 FROM f
  UNION ALL SELECT stock_code, report_year - 1, 'value', 3, CAST(revenue AS DOUBLE), NULL FROM f)
SELECT o.*, f.revenue AS filed, n.first_year AS newer FROM o LEFT JOIN f ON o.stock_code = f.stock_code AND o.report_year = f.report_year
LEFT JOIN (SELECT stock_code, min(report_year) AS first_year FROM f GROUP BY stock_code) n ON o.stock_code = n.stock_code AND n.first_year > o.report_year"""

#: The ten rules on a year's figures, with their thresholds.
FORENSICS = {
    "receivables_outrun_revenue": "g_receivables > 0 AND g_revenue > 0 AND g_receivables > 1.8 * g_revenue",
    "one_off_profit": "net_profit > 0 AND net_profit - deducted_profit > 0.15 * net_profit",
    "cash_below_profit": "net_profit > 0 AND operating_cash_flow < 0.5 * net_profit",
    "rd_capitalised": "rd_expense > 0 AND rd_capitalised >= 0.3 * rd_expense",
    "inventory_outruns_revenue": "g_inventory > 0 AND g_revenue > 0 AND g_inventory > 1.8 * g_revenue",
    "thin_impairment": "inventory > 0 AND impairment < 0.05 * inventory",
    "unfinished_assets": "fixed_assets > 0 AND construction > 0.5 * fixed_assets",
    "subsidy_dependent": "net_profit > 0 AND subsidies >= 0.3 * net_profit",
    "few_customers": "top5_share >= 50",
    "old_receivables": "receivables > 0 AND old_receivables >= 0.2 * receivables",
    "restricted_assets": "restricted_assets > 0",
}
#: The six derived ratios: numerator and denominator.
RATIOS = {
    "rd_to_revenue": ("rd_expense", "revenue"),
    "rd_to_gross_profit": ("rd_expense", "(revenue - cost)"),
    "outflow_to_cash": ("greatest(-operating_cash_flow, CAST(0 AS DECIMAL(24,2)))", "cash"),
    "receivables_to_revenue": ("receivables", "revenue"),
    "acquisitions_to_liquid": ("acquisitions", "(cash + fair_value_assets)"),
    "impairment_to_inventory": ("impairment", "inventory"),
}

QUERIES: dict[str, Query] = {
    "q_m01_annual_records": facts((), *dbl("revenue", "net_profit", "operating_cash_flow")),
    "q_m02_gross_margin": facts((stage(gross_margin=pct("(revenue - cost)", "revenue")),), "CAST(round(gross_margin, 2) AS DOUBLE) AS gross_margin"),
    "q_m03_integrity": Query(
        STORED,
        (
            stage(body=BODY),
            stage(actual=sha256("body")),
            stage(state="CASE WHEN stored_hash IS NULL THEN 'new' WHEN stored_hash = actual THEN 'unchanged' WHEN stored_hash = stored_actual THEN 'changed' ELSE 'corrupt' END"),
        ),
        ("stock_code", "CAST(report_year AS INT) AS report_year", "state", "state IN ('new', 'changed') AS to_write"),
        tables=TABLES,
    ),
    "q_m04_admission": long(ADMITTED, "reject_code"),
    "q_m05_series": long(
        ADMITTED_ONLY,
        final=f"""SELECT stock_code, metric_key, CAST(count(CASE WHEN bodies = 1 THEN 1 END) AS BIGINT) AS years, CAST(count(CASE WHEN bodies > 1 THEN 1 END) AS BIGINT) AS conflicts,
  CAST(min(CASE WHEN bodies = 1 THEN report_year END) AS INT) AS first_year, CAST(max(CASE WHEN bodies = 1 THEN report_year END) AS INT) AS last_year,
  CASE WHEN count(CASE WHEN bodies > 1 THEN 1 END) > 0 THEN 'conflicting_values_in_year' END AS diagnostic
FROM ({SERIES}) s GROUP BY stock_code, metric_key""",
    ),
    "q_m06_changes": long(
        ADMITTED_ONLY,
        final=f"""SELECT stock_code, CAST(report_year AS INT) AS report_year, metric_key, CAST(CASE WHEN gap = 1 THEN value - prev END AS DOUBLE) AS change,
  CASE WHEN gap = 1 THEN {pct("(value - prev)", "prev")} END AS growth,
  CASE WHEN prev IS NULL THEN 'first_period' WHEN gap <> 1 THEN 'non_consecutive_period_gap' WHEN prev <= 0 THEN 'non_positive_growth_base' END AS diagnostic
FROM (SELECT *, lag(value) OVER w AS prev, report_year - lag(report_year) OVER w AS gap FROM ({SERIES}) s WHERE bodies = 1 WINDOW w AS (PARTITION BY stock_code, metric_key ORDER BY report_year)) c""",
    ),
    "q_m07_cash_conversion": facts(CASH, "cash_ratio", "CASE WHEN net_profit <= 0 THEN 'non_positive_net_profit_for_cashflow_ratio' END AS diagnostic"),
    "q_m08_divergence": facts((*CHANGES, stage(rule="CASE WHEN g_revenue > 0 AND g_net_profit < 0 THEN 'revenue_up_profit_down' WHEN g_net_profit > 0 AND g_operating_cash_flow < 0 THEN 'profit_up_cash_down' END")), "rule", "g_revenue", "g_net_profit", where="rule IS NOT NULL"),
    "q_m09_trend": facts((*CHANGES, stage(_pg=f"lag(g_net_profit) {BY}"), stage(trend="CASE WHEN _pg > 0 AND g_net_profit < 0 THEN 'reversal' WHEN _pg < 0 AND g_net_profit > 0 THEN 'recovery' END")), "trend", where="trend IS NOT NULL"),
    "q_m10_cash_quality": facts((*CASH, stage(cash_quality="CASE WHEN weak AND NOT was_weak THEN 'deteriorated' WHEN NOT weak AND was_weak THEN 'recovered' WHEN weak THEN 'weak' ELSE 'sound' END")), "cash_quality", where="cash_ratio IS NOT NULL"),
    "q_m11_identity": long(
        (*ADMITTED_ONLY, stage(finding_id="concat_ws(':', stock_code, metric_key, CAST(CAST(report_year AS INT) AS VARCHAR(9)))", body=sha256("concat_ws('|', metric_key, currency, value_basis, CAST(value AS VARCHAR(40)))"))),
        final="SELECT finding_id, count(*) AS seen, count(DISTINCT body) AS bodies, CASE WHEN count(DISTINCT body) > 1 THEN 'conflicting_finding_identity' WHEN count(*) > 1 THEN 'merged' ELSE 'ok' END AS resolution FROM t GROUP BY finding_id",
    ),
    "q_m12_trend_view": facts((*CHANGES, stage(back="row_number() OVER (PARTITION BY stock_code ORDER BY report_year DESC)"), stage(where="back <= 3"), stage(n="count(*) OVER (PARTITION BY stock_code)", span="max(report_year) OVER (PARTITION BY stock_code) - min(report_year) OVER (PARTITION BY stock_code)")), *dbl("revenue", "net_profit"), "CASE WHEN g_revenue > 0 THEN 'up' WHEN g_revenue < 0 THEN 'down' ELSE 'flat' END AS direction", where="n = 3 AND span = 2"),
    "q_m13_risk_signals": facts(
        (*CASH, stage(signal="CASE WHEN net_profit <= 0 AND operating_cash_flow < 0 THEN 'loss_and_cash_outflow' WHEN cash_ratio < 0 THEN 'profit_without_cash' WHEN cash_ratio < 50 THEN 'weak_cash_conversion' END")),
        "signal", "CASE signal WHEN 'weak_cash_conversion' THEN 'medium' ELSE 'high' END AS severity", where="signal IS NOT NULL",
    ),
    "q_m14_core_facts": long((*ADMITTED_ONLY, stage(rk="row_number() OVER (PARTITION BY stock_code ORDER BY report_year DESC, metric_key, value)"), stage(display="CASE WHEN abs(value) >= 100000000 THEN '100m' WHEN abs(value) >= 10000 THEN '10k' ELSE 'unit' END")), "display", *dbl("value"), where="rk <= 6"),
    "q_m15_evidence_dedupe": long((), final="SELECT DISTINCT stock_code, CAST(report_year AS INT) AS report_year, metric_key, currency FROM t"),
    "q_m16_external_map": Query(
        EXTERNAL,
        (
            stage(half="CAST(power(10, digits) / 2 AS DOUBLE)"),
            stage(mapping="""CASE WHEN filed IS NULL AND newer IS NOT NULL THEN 'update' WHEN filed IS NULL THEN 'unmapped'
 WHEN kind = 'range' THEN CASE WHEN CAST(filed AS DOUBLE) BETWEEN lo AND hi THEN 'confirm' ELSE 'contradict' END
 WHEN abs(CAST(filed AS DOUBLE) - lo) <= half THEN 'confirm' ELSE 'contradict' END"""),
        ),
        ("stock_code", "CAST(report_year AS INT) AS report_year", "kind", "mapping"),
        tables=TABLES,
    ),
    "q_x07_forensics": Query(
        f"SELECT f.*, c.top5_share FROM ({FACTS}) f LEFT JOIN ({TOP_CUSTOMERS}) c ON f.stock_code = c.c_code AND f.report_year = c.c_year",
        (
            stage(**{f"p_{m}": f"lag({m}) {BY}" for m in ("revenue", "receivables", "inventory")}, gap=f"report_year - lag(report_year) {BY}"),
            stage(**{f"g_{m}": f"CASE WHEN gap = 1 THEN {pct(f'({m} - p_{m})', f'p_{m}')} END" for m in ("revenue", "receivables", "inventory")}),
            stage(flags="concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in FORENSICS.items()) + ")"),
        ),
        ("stock_code", "CAST(report_year AS INT) AS report_year", "flags"),
        "flags <> ''",
        tables=(*TABLES, "orders"),
    ),
    "q_x13_risk_ratios": facts((stage(**{name: pct(num, den) for name, (num, den) in RATIOS.items()}),), *RATIOS),
}
