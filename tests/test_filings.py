"""Tables of filings: layouts of real reports in several languages, line by line."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
import pytest

from ledgerlens.operators.filings import CHINESE, ENGLISH, FRENCH, GERMAN, LANGUAGES, ROWS_AT_ONCE, SPANISH, cells_of, concentration, in_ten_thousands, metric_rows, metric_with_growth, repaired, statement_cells, stock_rows
from ledgerlens.sources.filings import filings


def rows(reader, text, terms):
    out = {}
    for table, _, label, metric, _, value, factor in reader(text, terms):
        out.setdefault((table, label), {})[metric] = None if value is None else float(value * factor)
    return out


CHINESE_TABLES = """
主营业务分行业情况
分行业 营业收入 营业成本 毛利率（%） 营业收入比上年增减（%） 营业成本比上年增减（%） 毛利率比上年增减（%）
集成电路 2,500,000,000.25 1,500,000,000.50 40.00 14.25 12.96 增加0.75个百分点
主营业务分产品情况
分产品 营业收入 营业成本 毛利率（%） 营业收入比上年增减（%） 营业成本比上年增减（%） 毛利率比上年增减（%）
电源类 1,040,000,000.54 690,000,000.28 33.65 12.44 8.09 增加2.64个百分点
数 模 混 合 类 330,000,000.68 230,000,000.80 30.30 -0.83 6.68 -4.84
软件 7,000.11 0.00 100.00% -1.63% 0.00%
5G 模组 475,000.00 434,000.00 8.61 45.92 31.81 减少9.80个百分点
合计 9 9 9 9 9 9
主营业务分地区情况
分地区 某某电子（北京）股份有限公司 2025 年年度报告全文 22
国内 1,500,000.63 1,000,000.97 33.33 15.11 13.63 增加0.86个百分点
产销量情况分析表
主要产品 单位 生产量 销售量 库存量 生产量比上年增减（%） 销售量比上年增减（%） 库存量比上年增减（%）
电源类 万颗 131,477.02 128,731.91 10,154.28 13.19 10.61 51.80
数 模 混 合
SoC 类 万颗 44,349.66 46,639.47 5,446.70 10.21 22.09 61.04
公司前五名客户
前五名客户销售额 49,019.50 万元，占年度销售总额 99. 42%；其中前五名客户销售额中关联方销售额 0.00 万元，占年度销售总额 0.00%。
序号 客户名称 销售额 占年度销售总额比例（%） 是否与上市公司存在关联关系
1 客户一 10,835.52 87.4 9 否
合计 / 49,019.50 99.42 /
公司前五名供应商
前五名供应商合计采购金额（元） 357,000,000.64
前五名供应商合计采购金额占年度采购总额比例 41.58%
1 供应商 A 133,000,000.00 115.48%
"""


def test_chinese_tables():
    got = rows(metric_rows, CHINESE_TABLES, CHINESE)
    assert got["segment", "电源类"] == {"revenue": 1040000000.54, "cost": 690000000.28, "gross_margin": 33.65, "revenue_yoy": 12.44, "cost_yoy": 8.09, "margin_delta": 2.64}
    assert got["segment", "数模混合类"]["margin_delta"] == -4.84 and got["segment", "5G 模组"]["margin_delta"] == -9.8
    assert got["segment", "软件"] == {"revenue": 7000.11, "cost": 0.0, "gross_margin": 100.0, "revenue_yoy": -1.63, "margin_delta": 0.0}  # six columns
    assert set(got) == {("industry", "集成电路"), *(("segment", x) for x in ("电源类", "数模混合类", "软件", "5G 模组")), ("region", "国内")}
    stock = rows(stock_rows, CHINESE_TABLES, CHINESE)
    assert stock["stock", "电源类"]["stock_yoy"] == 51.8 and stock["stock", "数模混合 SoC 类"]["production"] == 44349.66  # a wrapped row
    five = rows(concentration, CHINESE_TABLES, CHINESE)
    assert five["customers", "customers"] == {"top_five_amount": 490195000.0, "top_five_share": 99.42, "related_amount": 0.0, "related_share": 0.0, "largest_amount": 108355200.0, "largest_share": 87.49}
    assert five["vendors", "vendors"] == {"top_five_amount": 357000000.64, "top_five_share": 41.58, "largest_amount": 133000000.0}  # a share above 100 goes


def test_whole_stock_and_titles_without_rows():
    text = "产销量情况\n销售量 颗 7,862,728,539 5,964,060,712 31.84%\n生产量 颗 8,610,305,518 6,481,555,180 32.84%\n库存量 颗 2,593,446,280 1,838,773,138 41.04%\n说明 5 5"
    assert rows(stock_rows, text, CHINESE) == {("stock", "whole"): {"sales": 7862728539, "sales_yoy": 31.84, "production": 8610305518, "production_yoy": 32.84, "stock": 2593446280, "stock_yoy": 41.04}}
    assert rows(stock_rows, text.replace("库存量 颗", "另 颗"), CHINESE) == {}
    assert rows(metric_rows, "A 1 2 3 4 5 6\nPrincipal operations by product\nDiscussion and analysis\nA 1 2 3 4 5 6", ENGLISH) == {}


def test_header_gives_the_columns_their_roles():
    text = "Principal operations by region\nUnit: USD million\n| Region | Gross margin | Revenue | Cost of sales |\n|---|---|---|---|\n| North | 50.0% | 1,234.5 | (2) |\n| Total | 50.0% | 9 | 9 |\n| South | — | 7 |"
    assert rows(metric_rows, text, ENGLISH) == {("region", "North"): {"gross_margin": 50.0, "revenue": 1234500000.0, "cost": -2000000.0}}


@pytest.mark.parametrize(
    ("terms", "text", "want"),
    [
        (GERMAN, "Hauptgeschäft nach Produkten\nin Tsd. EUR\nEUROPE\n1.209,54 814,74 32,64 112,75 — Rückgang um 1,72 Prozentpunkte", {("segment", "EUROPE"): {"revenue": 1209540.0, "cost": 814740.0, "gross_margin": 32.64, "revenue_yoy": 112.75, "cost_yoy": None, "margin_delta": -1.72}}),
        (FRENCH, "Activité principale par région\nen millions d'euros\nNord 3 155,71 2 101,19 33,42 % -15,03 % hausse de 0,27 points", {("region", "Nord"): {"revenue": 3155710000.0, "cost": 2101190000.0, "gross_margin": 33.42, "revenue_yoy": -15.03, "margin_delta": 0.27}}),
        (SPANISH, "Actividad principal por canal de venta\nTienda 2 1.073,01 736,36 31,37 34,15 41,19 -3,43", {("channel", "Tienda 2"): {"revenue": 1073.01, "cost": 736.36, "gross_margin": 31.37, "revenue_yoy": 34.15, "cost_yoy": 41.19, "margin_delta": -3.43}}),
    ],
)
def test_layouts_of_other_languages(terms, text, want):
    assert rows(metric_rows, text, terms) == want


def test_rows_of_one_label_count_once():
    text = "Principal operations by product\nA 1 2 3 4 5 6\nA 7 8 9 10 11 12\nA 1 2 3 4 5\nB 1 2 3 4 5"
    got = rows(metric_rows, text, ENGLISH)
    assert got["segment", "A"]["revenue"] == 1 and "cost_yoy" not in got["segment", "B"] and len(got) == 2


def test_five_largest_from_the_table_alone():
    text = "Principaux clients\nen milliers d'euros\n1 client A 150,99 4,78 /\nTotal / 2 634,83 20,12 /\nPrincipaux fournisseurs\n1 fournisseur A 0,00 120,00 /"
    assert rows(concentration, text, FRENCH) == {("customers", "customers"): {"top_five_amount": 2634830.0, "top_five_share": 20.12, "largest_amount": 150990.0, "largest_share": 4.78}}


def test_statement_rows_without_notes_and_dates():
    text = "Consolidated statement of income\nUnit: USD thousand\n31 December 2025 2024\nRevenue 5 1,622,274 664,237\nCost of sales 6, 12 (1,062.5) (356)\nOther 31\nDiscussion and analysis\nRevenue 5 1 2"
    got = rows(statement_cells, text, ENGLISH)
    assert got["statement", "Revenue"] == {"current": 1622274000.0, "prior": 664237000.0}
    assert ("statement", "Other") not in got and got["statement", "Cost of sales"]["current"] == -1062500.0


def test_value_and_growth():
    told = lambda text, *labels: metric_with_growth(text, labels, ENGLISH)
    assert told("Our revenue (note 5) was 1,234.5 million, year-on-year growth of 12.5 %, margin 40 %.", "turnover", "revenue") == ("revenue", Decimal("1234500000.0"), Decimal("12.5"))
    assert told("revenue 200 in 2024, share 7.5 %", "revenue")[1:] == (Decimal(200), Decimal("7.5"))
    assert told("revenue 300.0 against 200.0 before", "revenue")[1:] == (Decimal("300.0"), Decimal(50))
    assert told("net loss", "net") == ("net", None, None) and told("nothing", "revenue") is None
    assert metric_with_growth("营业收入为 5,327.92 万元，同比变动-55.78 %。", ["营业收入"], CHINESE) == ("营业收入", Decimal("53279200.00"), Decimal("-55.78"))


def test_broken_numbers_and_ten_thousands():
    assert repaired("占 99. 42% 与 87.4 9 ，数 模") == "占 99.42% 与 87.49 ，数模"
    assert in_ten_thousands(Decimal("1062041234.54"), 1) == Decimal("106204.12") and in_ten_thousands(Decimal("5"), 10) == Decimal("0.01") and in_ten_thousands(None, 1) is None


def test_odd_filings_on_spark(spark):
    odd = [("a", "en", None), ("b", None, ""), ("c", "xx", "Principal operations by product\nA 1 2 3 4 5 6"), (None, "zh", CHINESE_TABLES), ("d", "en", "Principal operations by product\n" + "word " * 50_000 + "\n" + "1 " * 20_000)]
    df = spark.createDataFrame(odd, "doc_id string, lang string, text string")
    got = cells_of(df, metric_rows, stock_rows, concentration, statement_cells)
    assert {r.doc_id for r in got.collect()} == {"c", None} and cells_of(df.limit(0), metric_rows).count() == 0
    assert set(LANGUAGES) == {"en", "de", "fr", "es", "zh"}


class Taken:
    """Hands out the function that would run in a worker."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


def test_rows_of_many_texts_are_given_on_in_parts():
    text = "\n".join(["Principal operations by product", "Unit: USD thousand", *(f"Item {chr(97 + k % 26)}{chr(97 + k // 26)} 1,000.00 500.00 50.00% 1.00% 2.00% 3.00" for k in range(300))])
    n = 60
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(k) for k in range(n)], "lang": ["en"] * n, "text": [text] * n})
    sizes = [b.num_rows for b in cells_of(Taken(), metric_rows)(iter([batch]))]
    of_one = sum(1 for _ in metric_rows(text, ENGLISH))
    assert of_one == 1800 and sum(sizes) == n * of_one
    assert max(sizes) < ROWS_AT_ONCE + of_one


def test_lines_are_read_once_and_dealt_by_company_once(spark):
    plan = filings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice#") and sum("FileScan" in x and "l_extendedprice" in x for x in plan.split("\n")) == 1
    assert sum("Exchange hashpartitioning(company" in x for x in plan.split("\n")) == 1 and "Expand" not in plan


def test_readers_of_one_text_cut_it_into_lines_once(monkeypatch):
    from ledgerlens.operators import filings as operator

    seen, cut = [], operator.repaired
    monkeypatch.setattr(operator, "repaired", lambda line: seen.append(line) or cut(line))
    text = "Principal operations by region\nNorth 1 2 3 4 5 6\nMajor customers\n1 customer A 5.00 10.00 no"
    batch = pa.RecordBatch.from_pydict({"doc_id": ["a", "b"], "lang": ["en", "en"], "text": [text, text + "\nno row"]})
    assert sum(b.num_rows for b in cells_of(Taken(), metric_rows, concentration)(iter([batch]))) == 2 * 8
    assert len(seen) == 4 + 5


def test_tasks_of_a_company_grow_with_the_lines(spark, monkeypatch):
    from ledgerlens.sources import filings as source

    few = source.tasks_of(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(source, "LINES_A_TASK", 250)
    many = source.tasks_of(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert few == source.LEAST_TASKS and many == -(-lines // 250)
    plan = filings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(company" in x and f", {many})" in x for x in plan.split("\n")) == 1


def test_facts_and_texts_come_from_one_pass_over_the_lines(spark):
    from ledgerlens.plans.filings import q_x14_fact_anchor

    plan = q_x14_fact_anchor(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
