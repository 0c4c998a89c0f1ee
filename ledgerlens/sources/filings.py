"""Annual filings as text: a company per supplier, a filing per year, with the tables that such reports print.

The numbers are sums over the lines of the year; they are written in the language of the company's home region, each with its own layout
(piped cells, wrapped rows, rows without a cost change, plain rows, undivided rows), units and digits. Companies
grow with the data, and a filing has a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The language of a filing by the region of its company.
HOMES = {"AMERICA": "en", "EUROPE": "de", "AFRICA": "fr", "MIDDLE EAST": "es", "ASIA": "zh"}
TABLES = ("lineitem", "supplier", "nation", "region", "part", "orders", "customer")
_LANG = "CASE r.r_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HOMES.items()) + " ELSE 'en' END"

#: Lines with their company, product class, kind of goods, region and trade of the customer; amounts in ten-thousandths, exact.
LINES = f"""SELECT s.s_name AS company, {_LANG} AS lang, year(l.l_shipdate) AS report_year, p.p_type AS segment, split_part(p.p_name, ' ', 2) AS industry,
  cr.r_name AS region, c.c_mktsegment AS channel, c.c_name AS customer, p.p_brand AS vendor, CAST(l.l_quantity AS BIGINT) AS made, CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE CAST(l.l_quantity AS BIGINT) END AS sold,
  CASE WHEN l.l_quantity > 40 THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END AS held,
  CAST(10000 * CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l.l_discount AS DECIMAL(4,2)) AS BIGINT) AS revenue,
  CAST(10000 * CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(0.55 + 2 * l.l_tax AS DECIMAL(4,2)) AS BIGINT) AS cost
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey"""

#: Amounts as printed, in hundredths of thousands (in Chinese filings of ones); rates in hundredths of a per cent.
_SHOWN = "CASE WHEN lang = 'zh' THEN ({0} + 50) {div} 100 ELSE ({0} + 50000) {div} 100000 END"
_SUMS = """SELECT company, lang, report_year, CASE WHEN grouping(segment) = 0 THEN 'segment' WHEN grouping(industry) = 0 THEN 'industry' WHEN grouping(region) = 0 THEN 'region' WHEN grouping(channel) = 0 THEN 'channel' ELSE 'whole' END AS section,
  coalesce(segment, industry, region, channel, '') AS label, CAST(sum(revenue) AS BIGINT) AS revenue_, CAST(sum(cost) AS BIGINT) AS cost_, CAST(sum(made) AS BIGINT) AS made, CAST(sum(sold) AS BIGINT) AS sold, CAST(sum(held) AS BIGINT) AS held
FROM l GROUP BY GROUPING SETS ((company, lang, report_year, segment), (company, lang, report_year, industry), (company, lang, report_year, region), (company, lang, report_year, channel), (company, lang, report_year))"""
_BEFORE = "OVER (PARTITION BY company, section, label ORDER BY report_year)"


def _cells(div: str) -> str:
    rate = lambda now, was: f"CASE WHEN {was} > 0 THEN CAST(round(10000.0 * ({now} - {was}) / {was}) AS BIGINT) END"
    return f"""WITH l AS ({LINES}), s AS ({_SUMS}),
n AS (SELECT company, lang, report_year, section, label, {_SHOWN.format('revenue_', div=div)} AS revenue, {_SHOWN.format('cost_', div=div)} AS cost, made, sold, held FROM s),
m AS (SELECT *, CAST(round(10000.0 * (revenue - cost) / nullif(revenue, 0)) AS BIGINT) AS margin FROM n),
b AS (SELECT *, lag(revenue) {_BEFORE} AS revenue_was, lag(cost) {_BEFORE} AS cost_was, lag(margin) {_BEFORE} AS margin_was, lag(made) {_BEFORE} AS made_was, lag(sold) {_BEFORE} AS sold_was, lag(held) {_BEFORE} AS held_was,
  min(report_year) OVER (PARTITION BY company) AS first_year FROM m)
SELECT company, lang, report_year, section, label, revenue, cost, margin, {rate('revenue', 'revenue_was')} AS revenue_yoy, {rate('cost', 'cost_was')} AS cost_yoy, margin - margin_was AS margin_delta, revenue_was, cost_was,
  made, sold, held, made_was, sold_was, held_was, {rate('made', 'made_was')} AS made_yoy, {rate('sold', 'sold_was')} AS sold_yoy, {rate('held', 'held_was')} AS held_yoy, report_year = first_year AS is_first FROM b"""


CELLS = (_cells("div"), _cells("//"))


def _largest(div: str, kind: str, amount: str) -> str:
    """The five largest customers or vendors of a year: their sum and the largest, as printed, with their shares."""
    return f"""SELECT company, lang, report_year, {_SHOWN.format('five', div=div)} AS five, {_SHOWN.format('one', div=div)} AS one, CAST(round(10000.0 * five / total) AS BIGINT) AS five_share, CAST(round(10000.0 * one / total) AS BIGINT) AS one_share
FROM (SELECT company, lang, report_year, CAST(sum(CASE WHEN rk <= 5 THEN v END) AS BIGINT) AS five, max(v) AS one, CAST(sum(v) AS BIGINT) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY company, report_year ORDER BY v DESC, {kind}) AS rk FROM (SELECT company, lang, report_year, {kind}, CAST(sum({amount}) AS BIGINT) AS v FROM ({LINES}) l GROUP BY company, lang, report_year, {kind}) a) b GROUP BY company, lang, report_year) c"""


CUSTOMERS = tuple(_largest(d, "customer", "revenue") for d in ("div", "//"))
VENDORS = tuple(_largest(d, "vendor", "cost") for d in ("div", "//"))

#: The wording of the five languages.
TITLES = {
    "segment": {"en": "Principal operations by product", "de": "Hauptgeschäft nach Produkten", "fr": "Activité principale par produit", "es": "Actividad principal por producto", "zh": "主营业务分产品情况"},
    "industry": {"en": "Principal operations by industry", "de": "Hauptgeschäft nach Branchen", "fr": "Activité principale par secteur", "es": "Actividad principal por sector", "zh": "主营业务分行业情况"},
    "region": {"en": "Principal operations by region", "de": "Hauptgeschäft nach Regionen", "fr": "Activité principale par région", "es": "Actividad principal por región", "zh": "主营业务分地区情况"},
    "channel": {"en": "Principal operations by sales channel", "de": "Hauptgeschäft nach Vertriebswegen", "fr": "Activité principale par canal de vente", "es": "Actividad principal por canal de venta", "zh": "主营业务分销售模式情况"},
    "stock": {"en": "Production, sales and stock", "de": "Produktion, Absatz und Bestand", "fr": "Production, ventes et stocks", "es": "Producción, ventas y existencias", "zh": "产销量情况分析表"},
    "customers": {"en": "Major customers", "de": "Wesentliche Kunden", "fr": "Principaux clients", "es": "Principales clientes", "zh": "公司前五名客户"},
    "vendors": {"en": "Major suppliers", "de": "Wesentliche Lieferanten", "fr": "Principaux fournisseurs", "es": "Principales proveedores", "zh": "公司前五名供应商"},
    "statement": {"en": "Consolidated statement of income", "de": "Konzern-Gewinn- und Verlustrechnung", "fr": "Compte de résultat consolidé", "es": "Cuenta de resultados consolidada", "zh": "合并利润表"},
    "discussion": {"en": "Discussion and analysis", "de": "Lagebericht", "fr": "Rapport de gestion", "es": "Informe de gestión", "zh": "管理层讨论与分析"},
}
UNITS = {"en": "Unit: USD thousand", "de": "in Tsd. EUR", "fr": "en milliers d'euros", "es": "en miles de euros", "zh": "单位：元"}
HEADERS = {
    "en": "| Item | Revenue | Cost of sales | Gross margin | Revenue change | Cost change | Margin change |",
    "de": "Position Umsatz Umsatzkosten Bruttomarge Umsatzveränderung Kostenveränderung Margenveränderung",
    "fr": "Poste Chiffre d'affaires Coût des ventes Marge brute Variation du chiffre d'affaires Variation de la marge",
    "es": "Partida Ingresos Coste de ventas Margen bruto Variación de ingresos Variación de coste Variación de margen",
    "zh": "项目 营业收入 营业成本 毛利率（%） 营业收入比上年增减（%） 营业成本比上年增减（%） 毛利率比上年增减（%）",
}
TOTALS = {"en": "Total", "de": "Summe", "fr": "Total", "es": "Total", "zh": "合计"}
REVENUE = {"en": "Revenue", "de": "Umsatzerlöse", "fr": "Chiffre d'affaires", "es": "Ingresos", "zh": "营业收入"}
COST = {"en": "Cost of sales", "de": "Umsatzkosten", "fr": "Coût des ventes", "es": "Coste de ventas", "zh": "营业成本"}
GROSS = {"en": "Gross profit", "de": "Bruttoergebnis", "fr": "Marge brute", "es": "Beneficio bruto", "zh": "毛利"}


def _say(of: dict[str, str]) -> Column:
    lang = F.col("lang")
    first, *rest = of.items()
    out = F.when(lang == first[0], first[1])
    for k, v in rest:
        out = out.when(lang == k, v)
    return out


def _digits(hundredths: Column) -> Column:
    """Hundredths with the separators of the language; a dash for what isn't known."""
    plain = F.format_number(hundredths / 100.0, 2)
    lang = F.col("lang")
    own = F.when(lang.isin("de", "es"), F.translate(plain, ",.", ".,")).when(lang == "fr", F.translate(plain, ",.", "\u202f,")).otherwise(plain)
    return F.coalesce(own, F.lit("—"))


def _rate(hundredths: Column) -> Column:
    lang = F.col("lang")
    return F.when(hundredths.isNull(), "—").otherwise(F.concat(_digits(hundredths), F.when(lang == "en", "%").when(lang == "fr", "\u202f%").otherwise("")))


def _points(hundredths: Column) -> Column:
    """A change in percentage points in words."""
    size, up = _digits(F.abs(hundredths)), hundredths >= 0
    word = lambda more, less: F.when(up, more).otherwise(less)
    lang = F.col("lang")
    said = (
        F.when(lang == "en", F.concat(word("+", "-"), size, F.lit(" pp")))
        .when(lang == "de", F.concat(word("Zunahme um ", "Rückgang um "), size, F.lit(" Prozentpunkte")))
        .when(lang == "fr", F.concat(word("hausse de ", "baisse de "), size, F.lit(" points")))
        .when(lang == "zh", F.concat(word("增加", "减少"), size, F.lit("个百分点")))
        .otherwise(_digits(hundredths))
    )
    return F.when(hundredths.isNull(), "—").otherwise(said)


def _row() -> Column:
    c = F.col
    lang, name = c("lang"), c("label")
    revenue, cost, margin, revenue_yoy, cost_yoy, delta = _digits(c("revenue")), _digits(c("cost")), _rate(c("margin")), _rate(c("revenue_yoy")), _rate(c("cost_yoy")), _points(c("margin_delta"))
    return (
        F.when(lang == "en", F.concat(F.lit("| "), F.concat_ws(" | ", name, revenue, cost, margin, revenue_yoy, cost_yoy, delta), F.lit(" |")))
        .when(lang == "de", F.concat(name, F.lit("\n"), F.concat_ws(" ", revenue, cost, margin, revenue_yoy, cost_yoy, delta)))
        .when(lang == "fr", F.concat_ws(" ", name, revenue, cost, margin, revenue_yoy, delta))
        .otherwise(F.concat_ws(" ", name, revenue, cost, margin, revenue_yoy, cost_yoy, delta))
    )


def _total() -> Column:
    """The row below the last table of operations."""
    c = F.col
    cells = (_say(TOTALS), _digits(c("revenue")), _digits(c("cost")), _rate(c("margin")), _rate(c("revenue_yoy")), _rate(c("cost_yoy")), _points(c("margin_delta")))
    plain = F.concat_ws(" ", *cells)
    return F.when(c("lang") == "en", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).otherwise(plain)


def _stock_rows() -> Column:
    """Production, sales and stock by product; Spanish filings print the company's as a whole."""
    c = F.col
    whole = [F.concat_ws(" ", F.lit(w), F.lit("kg"), _digits(c(k) * 100), _digits(c(f"{k}_was") * 100), _rate(c(f"{k}_yoy"))) for w, k in (("Ventas", "sold"), ("Producción", "made"), ("Existencias", "held"))]
    unit = F.when(c("lang") == "zh", "万颗").when(c("lang") == "en", "pcs").otherwise("kg")
    cells = [c("label"), unit, *(_digits(c(k) * 100) for k in ("made", "sold", "held")), *(_rate(c(f"{k}_yoy")) for k in ("made", "sold", "held"))]
    return F.when(c("lang") == "es", F.concat_ws("\n", *whole)).otherwise(F.concat_ws(" ", *cells))


def _concentration(customers: bool) -> Column:
    c = F.col
    five, one, five_share, one_share, none = _digits(c("five")), _digits(c("one")), _digits(c("five_share")), _digits(c("one_share")), _digits(F.lit(0))
    who = {"en": "customers" if customers else "suppliers", "de": "Kunden" if customers else "Lieferanten", "fr": "client" if customers else "fournisseur", "es": "Cliente" if customers else "Proveedor", "zh": "客户" if customers else "供应商"}
    deal, total = ("Sales to", "sales") if customers else ("Purchases from", "purchases")
    zh, zt = ("销售额", "占年度销售总额") if customers else ("采购额", "占年度采购总额")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    en = say(f"{deal} the five largest {who['en']} were ", five, " thousand, ", five_share, f"% of annual {total}; of these, related parties ", none, " thousand, ", none, f"%.\n1 {who['en'][:-1].title()} A ", one, " ", one_share, "% no")
    de = say(f"Gesamtbetrag der fünf größten {who['de']} ", five, f"\nAnteil der fünf größten {who['de']} ", five_share, f" %\nAnteil nahestehender {who['de']} ", none, f" %\n1 {who['de']} A ", one, " ", one_share, " %")
    rows = lambda w, s: say(f"1 {w} A ", one, s, one_share, " /\nTotal / ", five, s, five_share, " /")
    chinese = say(f"前五名{who['zh']}{zh} ", five, f" 元，{zt} ", five_share, f"%；其中前五名{who['zh']}{zh}中关联方{zh} ", none, f" 元，{zt} ", none, f"%。\n1 {who['zh']}一 ", one, " ", one_share, " 否")
    lang = c("lang")
    return F.when(lang == "en", en).when(lang == "de", de).when(lang == "fr", rows(who["fr"], " ")).when(lang == "zh", chinese).otherwise(rows(who["es"], " "))


def _statement() -> Column:
    """Rows with a note number, this year and the last; costs in brackets."""
    c = F.col
    line = lambda names, note, now, was: F.concat_ws(" ", _say(names), F.lit(note), now, was)
    years = F.concat_ws(" ", c("report_year").cast("string"), (c("report_year") - 1).cast("string"))
    paid = lambda x: F.when(x.isNull(), "—").otherwise(F.concat(F.lit("("), _digits(x), F.lit(")")))
    gross = lambda suffix: _digits(c(f"revenue{suffix}") - c(f"cost{suffix}"))
    return F.concat_ws("\n", years, line(REVENUE, "5", _digits(c("revenue")), _digits(c("revenue_was"))), line(COST, "6", paid(c("cost")), paid(c("cost_was"))), line(GROSS, "31", gross(""), gross("_was")))


def _discussion() -> Column:
    """A sentence on the revenue, in millions where the language has such a word."""
    c = F.col
    now = _digits(c("revenue"))
    yoy = c("revenue_yoy")
    thousand = _say({"en": "thousand", "de": "Tsd. EUR", "fr": "milliers d'euros", "es": "miles de euros", "zh": "元"})
    change = F.when(yoy.isNull(), F.lit("")).otherwise(F.concat(_say({"en": ", a year-on-year change of ", "de": ", Veränderung gegenüber Vorjahr ", "fr": ", variation sur un an de ", "es": ", variación interanual del ", "zh": "，同比变动"}), _digits(yoy), F.lit(" %")))
    return F.concat(_say(REVENUE), _say({"en": " amounted to ", "de": " betrugen ", "fr": " s'est élevé à ", "es": " fueron ", "zh": "为 "}), now, F.lit(" "), thousand, change, F.lit("."))


def _given(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _amount(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `LINES`, with marks of what was returned and of large lots for sold and held. A line is carried through the joins as few numbers, and meets the wide tables last."""
    t = _given(spark, sf_dir)
    quantity, long = F.col("l_quantity").cast("long"), lambda x: (F.lit(10000) * x).cast("long")
    line = t["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("report_year"), quantity.alias("made"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
        F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("large"),
        long(_amount("l_extendedprice") * (1 - F.col("l_discount")).cast("decimal(4,2)")).alias("revenue"), long(_amount("l_extendedprice") * F.expr("0.55 + 2 * l_tax").cast("decimal(4,2)")).alias("cost"),
    )
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    home = F.lit("en")
    for name, lang in HOMES.items():
        home = F.when(F.col("r_name") == name, lang).otherwise(home)
    company = t["supplier"].join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("company"), home.alias("lang"))
    buyer = t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("region"), F.col("c_mktsegment").alias("channel"), F.col("c_name").alias("customer"))
    order = t["orders"].select("o_orderkey", "o_custkey").join(buyer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    goods = t["part"].select("p_partkey", F.col("p_type").alias("segment"), F.expr("split_part(p_name, ' ', 2)").alias("industry"), F.col("p_brand").alias("vendor"))
    line = line.join(company, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
    line = line.join(goods, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")


def tasks_of(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the lines dealt by company: lines are counted from the footers, and every task gets about as many, however many there are."""
    return max(LEAST_TASKS, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // LINES_A_TASK))


#: A line becomes a row in each section, so a task holds several rows for each of its lines.
LINES_A_TASK, LEAST_TASKS = 100_000, 8
#: Sections of a year's sums: the column of lines that labels them, none for the whole.
SECTIONS = {"segment": "segment", "industry": "industry", "region": "region", "channel": "channel", "whole": None, "customer": "customer", "vendor": "vendor"}


def sums_of(lines: DataFrame, sections: tuple[str, ...], tasks: int) -> DataFrame:
    """(company, lang, report_year, section, label, sums) of the sections, on the company's partition: lines are dealt by company
    once, to so many tasks, and all that follows for a company or a year of it needs no further shuffle."""
    key = {s: F.col(c) if (c := SECTIONS[s]) else F.lit(None).cast("string") for s in sections}
    of = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), k.alias("label")) for s, k in key.items()))).alias("of")
    used = [c for s in sections if (c := SECTIONS[s])]
    numbers = ("revenue", "cost", "made", "sold", "held")
    dealt = lines.select("company", "lang", "report_year", *used, "revenue", "cost", "made", "returned", "large").repartition(tasks, "company")
    dealt = dealt.withColumn("sold", F.when(F.col("returned") == 1, 0).otherwise(F.col("made"))).withColumn("held", F.when(F.col("large") == 1, F.col("made")).otherwise(0))
    rows = dealt.select("company", "lang", "report_year", of, *numbers).select("company", "lang", "report_year", "of.section", "of.label", *numbers)
    return rows.groupBy("company", "lang", "report_year", "section", "label").agg(*(F.sum(c).alias(c) for c in numbers)).withColumn("label", F.coalesce("label", F.lit("")))


def _shown(amount: str) -> str:
    return _SHOWN.format(amount, div="div")


def cells_of_years(sums: DataFrame) -> DataFrame:
    """The columns of `CELLS` for `sums`, whose exact sums stay as revenue_ and cost_."""
    rate = lambda now, was: f"CASE WHEN {was} > 0 THEN CAST(round(10000.0 * ({now} - {was}) / {was}) AS BIGINT) END"
    shown = sums.withColumnsRenamed({"revenue": "revenue_", "cost": "cost_"}).selectExpr("*", f"{_shown('revenue_')} AS revenue", f"{_shown('cost_')} AS cost")
    shown = shown.selectExpr("*", "CAST(round(10000.0 * (revenue - cost) / nullif(revenue, 0)) AS BIGINT) AS margin")
    before = shown.selectExpr("*", *(f"lag({c}) {_BEFORE} AS {c}_was" for c in ("revenue", "cost", "margin", "made", "sold", "held")), "min(report_year) OVER (PARTITION BY company) AS first_year")
    return before.selectExpr("*", *(f"{rate(c, f'{c}_was')} AS {c}_yoy" for c in ("revenue", "cost", "made", "sold", "held")), "margin - margin_was AS margin_delta", "report_year = first_year AS is_first")


def _five(cells: DataFrame, of: str) -> list[Column]:
    """The five largest of a year, the largest, and their shares, as `_largest` has them; `cells` has their amount v and place rk."""
    here, v = F.col("section") == of, F.col("v")
    return [F.sum(F.when(here & (F.col("rk") <= 5), v)).alias(f"{of}_five"), F.max(F.when(here, v)).alias(f"{of}_one"), F.sum(F.when(here, v)).alias(f"{of}_total")]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, report_year, lang, doc_id and the text of every filing, with revenue, cost and made of the whole year as its statement has them."""
    by = ["company", "report_year", "lang"]
    section, none = F.col("section"), F.lit("")
    whole, at = section == "whole", lambda n, label, line: F.struct(F.lit(n).alias("at"), label.alias("label"), line.alias("line"))
    head = lambda name: F.concat_ws("\n", _say(TITLES[name]), _say(UNITS), _say(HEADERS))
    label = F.col("label")
    printed = F.array(
        F.when(whole, at(10, none, F.when(F.col("is_first"), head("industry")).otherwise(head("segment")))),
        F.when((section == "segment") & ~F.col("is_first") | (section == "industry") & F.col("is_first"), at(11, label, _row())),
        F.when(whole, at(30, none, head("region"))),
        F.when(section == "region", at(31, label, _row())),
        F.when(whole, at(40, none, head("channel"))),
        F.when(section == "channel", at(41, label, _row())),
        F.when(whole, at(50, none, F.concat_ws("\n", _total(), _say(TITLES["stock"])))),
        F.when(section == F.when(F.col("lang") == "es", "whole").otherwise("segment"), at(51, label, _stock_rows())),
        F.when(whole, at(80, none, F.concat_ws("\n", _say(TITLES["statement"]), _say(UNITS), _statement(), _say(TITLES["discussion"]), _discussion()))),
    )
    largest = "CASE section WHEN 'customer' THEN revenue_ WHEN 'vendor' THEN cost_ END"
    cells = cells_of_years(sums_of(lines_of(spark, sf_dir), tuple(SECTIONS), tasks_of(spark, sf_dir))).selectExpr("*", f"{largest} AS v")
    cells = cells.selectExpr("*", "row_number() OVER (PARTITION BY company, report_year, section ORDER BY v DESC, label) AS rk")
    shown = ("revenue", "cost", "made")
    some = cells.select(*by, "section", "v", "rk", *shown, F.array_compact(printed).alias("p"))
    year = some.groupBy(*by).agg(F.flatten(F.collect_list("p")).alias("p"), *_five(some, "customer"), *_five(some, "vendor"), *(F.max(F.when(whole, F.col(c))).alias(c) for c in shown))
    for k, of, t in ((60, "customer", "customers"), (70, "vendor", "vendors")):
        five, one, total = f"{of}_five", f"{of}_one", f"{of}_total"
        year = year.selectExpr(
            *(c for c in year.columns if not c.startswith(f"{of}_") and c not in ("five", "one", "five_share", "one_share")), f"{_shown(five)} AS five", f"{_shown(one)} AS one",
            *(f"CAST(round(10000.0 * {x} / {total}) AS BIGINT) AS {y}" for x, y in ((five, "five_share"), (one, "one_share"))),
        )
        year = year.withColumn("p", F.concat("p", F.array(at(k, none, F.concat_ws("\n", _say(TITLES[t]), _say(UNITS), _concentration(t == "customers"))))))
    text = F.array_join(F.transform(F.sort_array("p"), lambda x: x["line"]), "\n")
    return year.select(F.concat_ws("-", "company", "report_year").alias("doc_id"), *by, text.alias("text"), *shown)
