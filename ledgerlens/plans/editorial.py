"""Product and project evidence of documents (X16) and the editorial choice of each stock's rows.

Evidence: around each marker a snippet within its sentence, at most 60 characters before and 180 behind; markers inside a snippet don't begin
another. Snippets need a word of their bucket's context or a technical name, glossaries and table debris go, equal ones count once, and the
best five of each document and bucket stay.

Choice: a stock gets one portrait, the best complete row on what it does; then each role its budget of rows by rank (3, 4, 3, 3, 6, the portrait's role one
less). Financial rows are chosen in three steps: two core facts or more merge into one overview; the best row of each dimension; the best of the rest. Rows are cut to the
few best of each combination of dimensions before stocks are ranked, so no task sorts a whole stock.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import both, match_re, replace_re
from .stages import Expr, Query, stage
from .texts import DOCS, SENTENCES

#: Markers and words of context of the six buckets, in four languages.
MARKERS = {
    "customer_chain": "customers?|clients?|kunden|clientes|supplied to|used by|applied in|eingesetzt|utilisé|OEM|end users?",
    "sales_model": "direct sales|distribut\\w*|channel|reseller|vertrieb|canal|licen[cs]\\w*|lizenz\\w*|subscription",
    "frequency_coverage": "version \\d|[2-6]G\\b|GHz|Wi-?Fi|band|platform|software|plattform",
    "product_lines": "mass production|certif\\w*|testing|released?|shipped|launched|licensed under|serienproduktion|freigegeben|publié|lanzad\\w*",
    "business_significance": "market share|revenue|growth|leading|first in|umsatz|marktanteil|croissance|crecimiento|cost saving",
}
MARKERS["project_statuses"] = MARKERS["product_lines"]
CONTEXT = {
    "customer_chain": "customer|client|kunde|cliente|brand|oem|module|terminal|partner|vehicle|mail",
    "frequency_coverage": "[2-6]g\\b|ghz|wi-?fi|band|chip|module|software|licen",
    "product_lines": "product|software|chip|module|platform|material|licen|version|produkt|logiciel",
}
CONTEXT["project_statuses"] = CONTEXT["product_lines"]
TECHNICAL = "[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)+|\\b[A-Z]{2,}\\b|\\b[A-Z][a-z]+[A-Z][a-zA-Z0-9]*|\\b[0-9]+[A-Za-z]+"
GLOSSARY = "\\bmeans\\b.*\\bmeans\\b|hereinafter|stock exchange|stock code|abbreviation|im folgenden|ci-après|en adelante"
BEFORE, AFTER, SHORTEST, LONGEST, KEPT = 60, 180, 12, 260, 5


def _window(bucket: str) -> str:
    return f"(?i).{{0,{BEFORE}}}(?:{MARKERS[bucket]}).{{0,{AFTER}}}"


#: Sentences with a marker are found first, and only they are searched for windows.
_SNIPPETS = (
    "SELECT doc_id, bucket, raw FROM (SELECT doc_id, p.bucket AS bucket, explode(filter(split(text, '[.!?;\\n]'), x -> x RLIKE p.marker)) AS sentence, p.around AS around FROM documents LATERAL VIEW explode(array("
    + ", ".join(f"named_struct('bucket', '{b}', 'marker', r'(?i){m}', 'around', r'{_window(b)}')" for b, m in MARKERS.items())
    + ")) t AS p WHERE doc_id IS NOT NULL) s LATERAL VIEW explode(regexp_extract_all(sentence, around, 0)) u AS raw",
    " UNION ALL ".join(
        f"SELECT doc_id, '{b}' AS bucket, unnest(regexp_extract_all(sentence, '{_window(b)}')) AS raw FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?;\n]')) AS sentence FROM documents WHERE doc_id IS NOT NULL) s"
        for b in MARKERS
    ),
)


def _of_bucket(words: dict[str, str], column: str) -> tuple[str, str]:
    """True where the bucket has no such words or the text one of its own."""
    parts = [(b, match_re(column, w)) for b, w in words.items()]
    return tuple("CASE bucket " + " ".join(f"WHEN '{b}' THEN {m[k]}" for b, m in parts) + " ELSE true END" for k in (0, 1))


def _count(column: str, words: str) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words.split("|"))


EVIDENCE = Query(
    _SNIPPETS,
    (
        stage(flat=replace_re("raw", "\\s+", " ")),
        stage(snippet="trim(flat)"),
        stage(low="lower(snippet)", numbers=("size(regexp_extract_all(snippet, r'(?:^| )[-(]?[0-9][0-9.,]*(?:%|[)])?(?: |$)', 0))", "len(regexp_extract_all(snippet, '(?:^| )[-(]?[0-9][0-9.,]*(?:%|[)])?(?: |$)'))")),
        stage(technical=match_re("snippet", TECHNICAL), glossary=match_re("low", GLOSSARY), fits=_of_bucket(CONTEXT, "low")),
        stage(where=f"length(snippet) >= {SHORTEST} AND NOT glossary AND numbers < 3 AND (fits OR technical)"),
        stage(
            score=both("2.0 * CAST(technical AS INT) + 1.5 * CAST({0} AS INT) + 1.5 * CAST({1} AS INT) + 1.0 * CAST({2} AS INT)", match_re("low", MARKERS["product_lines"]), match_re("low", "certif|passed test"), match_re("low", MARKERS["business_significance"]))
        ),
        stage(score=f"CAST(score AS DOUBLE) + least(0.5 * ({_count('low', 'customer|client|software|chip|module|platform|version|licen|release|certif')}), 3.0) - greatest(0, length(snippet) - 120) / 120.0"),
        stage(snippet=f"CASE WHEN length(snippet) > {LONGEST} THEN concat(rtrim(substr(snippet, 1, {LONGEST - 1})), '…') ELSE snippet END"),
    ),
    final=f"""SELECT doc_id, bucket, CAST(rk AS INT) AS place, snippet, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY round(score, 6) DESC, snippet) AS rk
  FROM (SELECT doc_id, bucket, snippet, max(score) AS score FROM t GROUP BY doc_id, bucket, snippet) u) v WHERE rk <= {KEPT}""",
    tables=DOCS,
)

#: Rows a role may show.
BUDGETS = {"business_structure": 3, "operating_progress": 4, "market_competition_outlook": 3, "technology_product_progress": 3, "financial_quality_explanation": 6}
PORTRAIT = ("business_structure", "operating_progress", "technology_product_progress")
#: Words by which rows get roles, ranks and dimensions: parameters.
ROLES = {
    "financial_quality_explanation": ("revenue", "profit", "cash", "price", "cost", "umsatz", "gewinn", "bénéfice", "ingresos", " | "),
    "technology_product_progress": ("version", "software", "release", "technolog", "patent", "chip", "entwickl", "logiciel"),
    "market_competition_outlook": ("compet", "market", "share", "markt", "marché", "mercado", "worthless"),
    "operating_progress": ("order", "deliver", "customer", "mail", "phone", "liefer", "commande", "pedido"),
}
SIGNALS = ("because", "due to", "year-on-year", "customer", "order", "release", "deliver", "revenue", "profit", "margin", "cash", "licen", "version")
CORE = {"revenue": ("revenue", "umsatz", "chiffre", "ingresos", " | "), "profit": ("profit", "gewinn", "bénéfice", "price"), "cash": ("cash", "trésorerie", "caja", "token")}


def any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_ROLE = "CASE " + " ".join(f"WHEN {any_of('low', w)} THEN '{r}'" for r, w in ROLES.items()) + " ELSE 'business_structure' END"
_DIGIT: Expr = match_re("sentence", "[0-9]")
_RANKED = "score DESC, penalty, id"
_WORTH = "insight DESC, id"
#: A source's rows are cut in so many parts before it is looked at as a whole.
PARTS = 64


def _candidates(rows: DataFrame) -> DataFrame:
    """The rows of each part of a source that may be among its best by score, worth or portrait: the best of all are among the best of their parts."""
    of = "PARTITION BY source, _part"
    group = f"{of}, role, dimensions, coalesce(core, '')"
    cut = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS))).selectExpr(
        "*", f"row_number() OVER ({of} ORDER BY coalesce(portrait, -1) DESC, id) AS _portrait", f"row_number() OVER ({group} ORDER BY {_RANKED}) AS _score", f"row_number() OVER ({group} ORDER BY {_WORTH}) AS _worth"
    )
    return cut.where("_score <= 12 OR _worth <= 12 OR _portrait <= 1").drop("_part", "_portrait", "_score", "_worth")


CHOICE = Query(
    SENTENCES,
    (
        stage(where="source IS NOT NULL"),
        stage(low="lower(sentence)", id="doc_id * 100000 + pos", n="length(replace(sentence, ' ', ''))", digit=both("CAST({0} AS INT)", _DIGIT), code=both("CAST({0} AS INT)", match_re("sentence", "[A-Za-z]+[0-9]+|[0-9][GT]\\b")), complete=both("CAST({0} AS INT)", match_re("sentence", "^[A-ZÀ-Þ].*[^,:;]$"))),
        stage(role=_ROLE, signals=" + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in SIGNALS), penalty="CASE WHEN n BETWEEN 24 AND 320 THEN 0 ELSE abs(least(greatest(n, 24), 320) - n) END"),
        stage(
            score="4 * signals + 2 * digit + 2 * complete + 3 * digit + 2 * code", core="CASE WHEN role = 'financial_quality_explanation' AND digit = 1 THEN " + "CASE " + " ".join(f"WHEN {any_of('low', w)} THEN '{k}'" for k, w in CORE.items()) + " END END",
            performance=f"digit = 1 AND {any_of('low', ('growth', 'decline', 'increase', 'decrease', '%', 'wachstum', 'croissance', ' | '))}", quality=any_of("low", ("cash", "inventor", "impairment", "receivable", "debt", "cost", "price")), driver=any_of("low", ("because", "due to", "demand", "customer", "owing", "weil", "parce", "porque")),
            portrait=f"CASE WHEN role IN {PORTRAIT} AND complete = 1 AND n >= 24 THEN {_count('low', 'business|company|product|customer|software|market|licen|application')} END",
        ),
        stage(dimensions="CAST(performance AS INT) + 2 * CAST(quality AS INT) + 4 * CAST(driver AS INT)"),
        stage(insight="4 * (CAST(performance AS INT) + CAST(quality AS INT) + CAST(driver AS INT)) + 2 * digit + 5 * CAST(contains(low, 'profit') AS INT) + complete"),
        # the few best of each combination, and of each core fact, are all that can be chosen
        replace(stage(by_score=f"row_number() OVER (PARTITION BY source, role, dimensions, coalesce(core, '') ORDER BY {_RANKED})", by_worth=f"row_number() OVER (PARTITION BY source, role, dimensions, coalesce(core, '') ORDER BY {_WORTH})", by_portrait="row_number() OVER (PARTITION BY source ORDER BY coalesce(portrait, -1) DESC, id)"), spread=_candidates),
        stage(where="by_score <= 12 OR by_worth <= 12 OR by_portrait <= 1"),
        stage(is_portrait="by_portrait = 1 AND portrait IS NOT NULL"),
        stage(cores="max(CASE WHEN core = 'revenue' AND NOT is_portrait THEN 1 ELSE 0 END) OVER (PARTITION BY source) + max(CASE WHEN core = 'profit' AND NOT is_portrait THEN 1 ELSE 0 END) OVER (PARTITION BY source) + max(CASE WHEN core = 'cash' AND NOT is_portrait THEN 1 ELSE 0 END) OVER (PARTITION BY source)", portrait_role="max(CASE WHEN is_portrait THEN role END) OVER (PARTITION BY source)"),
        stage(merged="NOT is_portrait AND core IS NOT NULL AND cores >= 2", fact="row_number() OVER (PARTITION BY source, coalesce(core, ''), is_portrait ORDER BY " + _WORTH + ")"),
        stage(open_row="NOT is_portrait AND NOT merged"),
        stage(p="CASE WHEN open_row AND performance AND role = 'financial_quality_explanation' THEN insight * 1000000000000 - id END"),
        stage(p_best="max(p) OVER (PARTITION BY source)"),
        stage(is_p="coalesce(p = p_best, false)"),
        stage(q="CASE WHEN open_row AND quality AND NOT is_p AND role = 'financial_quality_explanation' THEN insight * 1000000000000 - id END"),
        stage(q_best="max(q) OVER (PARTITION BY source)"),
        stage(is_q="coalesce(q = q_best, false)"),
        stage(d="CASE WHEN open_row AND driver AND NOT is_p AND NOT is_q AND role = 'financial_quality_explanation' THEN insight * 1000000000000 - id END"),
        stage(d_best="max(d) OVER (PARTITION BY source)"),
        stage(slot="CASE WHEN is_portrait THEN 'portrait' WHEN merged THEN 'overview' WHEN is_p THEN 'performance' WHEN is_q THEN 'quality' WHEN coalesce(d = d_best, false) THEN 'driver' ELSE 'row' END"),
        stage(first_step="CASE slot WHEN 'overview' THEN 0 WHEN 'performance' THEN 1 WHEN 'quality' THEN 2 WHEN 'driver' THEN 3 ELSE 4 END"),
        stage(taken="CASE WHEN role = 'financial_quality_explanation' AND cores >= 2 THEN 1 ELSE 0 END + CASE WHEN role = portrait_role THEN 1 ELSE 0 END", budget="CASE role " + " ".join(f"WHEN '{r}' THEN {b}" for r, b in BUDGETS.items()) + " END"),
        stage(rk="CASE WHEN open_row THEN row_number() OVER (PARTITION BY source, role, open_row ORDER BY CASE WHEN role = 'financial_quality_explanation' THEN first_step ELSE 0 END, CASE WHEN role = 'financial_quality_explanation' THEN insight ELSE score END DESC, CASE WHEN role = 'financial_quality_explanation' THEN 0 ELSE penalty END, id) END"),
    ),
    final="""SELECT source, role, slot, doc_id, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN slot = 'portrait' THEN 0 WHEN merged THEN 1 ELSE rk + taken END AS INT) AS place FROM t
WHERE is_portrait OR (merged AND fact = 1) OR (open_row AND rk + taken <= budget AND (role <> 'financial_quality_explanation' OR insight >= 0))""",
    tables=DOCS,
)
QUERIES = {"q_x16_project_evidence": EVIDENCE, "q_a06_editorial": CHOICE}
