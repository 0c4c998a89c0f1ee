"""Tables of filings, read line by line.

A filing is a stream of lines. A title opens a table, another title or an end marker closes it; inside, a line that only names a unit
sets it for the rows below, a line of column names gives the columns their roles (else the
forms are tried in order: seven columns, then six), a line without numbers is the beginning of a wrapped row,
and a row with numbers is cut into a label and its cells. Numbers follow the separators of the filing's language; a dash is an
empty cell. Words, units and separators are parameters (`Terms`), with defaults for five languages.

Every function takes one text; Spark deals the filings out and streams them through Arrow, so none meets another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

FORMS = {
    "metrics": (("revenue", "cost", "gross_margin", "revenue_yoy", "cost_yoy", "margin_delta"), ("revenue", "cost", "gross_margin", "revenue_yoy", "margin_delta")),
    "stock": (("production", "sales", "stock", "production_yoy", "sales_yoy", "stock_yoy"),),
}
METRIC_TABLES = ("segment", "industry", "region", "channel")
AMOUNTS = frozenset({"revenue", "cost", "current", "prior", "top_five_amount", "largest_amount", "related_amount", "metric"})
#: A label may be so far from its value, and a wrapped row's beginning so long.
SPAN, WRAP = 220, 60
LONGEST_TITLE, LONGEST_HEADER = 160, 400


@dataclass(frozen=True, eq=False)
class Terms:
    """How one language writes its filings."""

    group: str
    point: str
    titles: dict[str, tuple[str, ...]]  # of tables and of the parts that end them
    units: tuple[tuple[str, int], ...]  # the first that a line holds counts
    roles: tuple[tuple[str, str], ...]  # column names, longer ones first
    more: tuple[str, ...]  # before a change in percentage points
    less: tuple[str, ...]
    points: tuple[str, ...]
    junk: tuple[str, ...]  # labels that are no item
    stock: tuple[tuple[str, str], ...]  # rows of a company's whole stock
    five: dict[str, tuple[str, ...]]  # patterns of the five largest: amount and share, share alone, related parties
    total: str
    change: tuple[str, ...]  # before a change on the year
    measures: str = "pcs|kg|t|units|万颗|KG|吨|万件|台|件|米|个|颗"

    @cached_property
    def number(self) -> str:
        group, point = re.escape(self.group), re.escape(self.point)
        return rf"(?:\d{{1,3}}(?:{group}\d{{3}})+|\d+)(?:{point}\d+)?"

    @cached_property
    def cell(self) -> str:
        return rf"(?:\(-?{self.number}\)|[-−+]?{self.number}(?:\s?%)?|[—–/-])"

    @cached_property
    def number_pattern(self) -> re.Pattern:
        return re.compile(self.number)

    @cached_property
    def title_words(self) -> tuple[str, ...]:
        return tuple(w for words in self.titles.values() for w in words)

    @cached_property
    def delta(self) -> str:
        words = "|".join(map(re.escape, (*self.more, *self.less)))
        return rf"(?:(?:{words}) *)?{self.cell}(?: *(?:{'|'.join(map(re.escape, self.points))}))?"

    @cached_property
    def rows(self) -> dict[str, list[tuple[tuple[str, ...], re.Pattern]]]:
        def pattern(roles: tuple[str, ...]) -> re.Pattern:
            head = rf"(?P<label>\S.*?) +(?P<unit>{self.measures})" if "production" in roles else r"(?P<label>\S.*?)"
            cells = (rf" +(?P<{r}>{self.delta if r == 'margin_delta' else self.cell})" for r in roles)
            return re.compile(rf"^{head}{''.join(cells)}$")

        return {kind: [(f, pattern(f)) for f in forms] for kind, forms in FORMS.items()}

    @cached_property
    def unit_patterns(self) -> list[tuple[re.Pattern, int]]:
        """Units as whole words; in scripts without blanks as they stand."""
        edge = lambda word: word if ord(word[0]) > 0x2E7F else rf"(?<!\w){word}(?!\w)"
        return [(re.compile(edge(re.escape(word))), factor) for word, factor in self.units]

    def value(self, raw: str) -> Decimal | None:
        """The number of a cell: brackets and words for less make it negative; a dash is none."""
        found = self.number_pattern.search(raw)
        if not found:
            return None
        digits = found[0].replace(self.group, "").replace(self.point, ".")
        try:
            out = Decimal(digits)
        except InvalidOperation:
            return None
        before = raw[: found.start()]
        negative = before.endswith(("-", "−")) or raw.strip().startswith("(") or any(w in before for w in self.less)
        return -out if negative else out

    def unit(self, line: str) -> int | None:
        low = line.lower()
        return next((factor for found, factor in self.unit_patterns if found.search(low)), None)

    def only_unit(self, line: str) -> bool:
        """True for a line that says nothing but its unit."""
        low = line.lower()
        for found, _ in self.unit_patterns:
            low = found.sub("", low)
        return len(re.sub(r"\W", "", low)) <= 12


#: The wording of filings in five languages.
ENGLISH = Terms(
    ",", ".",
    {"segment": ("principal operations by product",), "industry": ("principal operations by industry",), "region": ("principal operations by region",), "channel": ("principal operations by sales channel",),
     "stock": ("production, sales and stock",), "customers": ("major customers",), "vendors": ("major suppliers",), "statement": ("consolidated statement of income",), "end": ("discussion and analysis", "cost analysis")},
    (("billion", 10**9), ("million", 10**6), ("thousand", 10**3), ("usd", 1)),
    (("revenue change", "revenue_yoy"), ("cost change", "cost_yoy"), ("margin change", "margin_delta"), ("gross margin", "gross_margin"), ("revenue", "revenue"), ("cost of sales", "cost")),
    ("increase of", "up"), ("decrease of", "down"), ("percentage points", "pp"), ("total", "revenue", "gross margin", "unit"),
    (("production", "production"), ("sales", "sales"), ("stock", "stock")),
    {"pair": (r"the five largest {who} were {n} thousand, {n}%",), "share": (r"five largest {who} account for {n}\s?%",), "related": (r"related parties {n} thousand, {n}%",)},
    "total", ("year-on-year", "year on year", "growth", "increase", "decrease", "change"),
)
GERMAN = Terms(
    ".", ",",
    {"segment": ("hauptgeschäft nach produkten",), "industry": ("hauptgeschäft nach branchen",), "region": ("hauptgeschäft nach regionen",), "channel": ("hauptgeschäft nach vertriebswegen",),
     "stock": ("produktion, absatz und bestand",), "customers": ("wesentliche kunden",), "vendors": ("wesentliche lieferanten",), "statement": ("gewinn- und verlustrechnung",), "end": ("lagebericht",)},
    (("mrd. eur", 10**9), ("mio. eur", 10**6), ("tsd. eur", 10**3), ("teur", 10**3), ("eur", 1)),
    (("umsatzveränderung", "revenue_yoy"), ("kostenveränderung", "cost_yoy"), ("margenveränderung", "margin_delta"), ("bruttomarge", "gross_margin"), ("umsatzkosten", "cost"), ("umsatz", "revenue")),
    ("Zunahme um",), ("Rückgang um",), ("Prozentpunkte",), ("summe", "umsatz", "bruttomarge"),
    (("produktion", "production"), ("absatz", "sales"), ("bestand", "stock")),
    {"amount": (r"gesamtbetrag der fünf größten {who} {n}",), "share": (r"anteil der fünf größten {who} {n}\s?%",), "related_share": (r"anteil nahestehender {who} {n}\s?%",)},
    "summe", ("gegenüber vorjahr", "veränderung", "zunahme", "rückgang"),
)
FRENCH = Terms(
    "\u202f", ",",
    {"segment": ("activité principale par produit",), "industry": ("activité principale par secteur",), "region": ("activité principale par région",), "channel": ("activité principale par canal de vente",),
     "stock": ("production, ventes et stocks",), "customers": ("principaux clients",), "vendors": ("principaux fournisseurs",), "statement": ("compte de résultat",), "end": ("rapport de gestion",)},
    (("milliards d'euros", 10**9), ("millions d'euros", 10**6), ("milliers d'euros", 10**3), ("euros", 1)),
    (("variation du chiffre d'affaires", "revenue_yoy"), ("variation du coût", "cost_yoy"), ("variation de la marge", "margin_delta"), ("marge brute", "gross_margin"), ("chiffre d'affaires", "revenue"), ("coût des ventes", "cost")),
    ("hausse de",), ("baisse de",), ("points",), ("total", "chiffre d'affaires", "marge brute"),
    (("production", "production"), ("ventes", "sales"), ("stocks", "stock")), {}, "total", ("sur un an", "variation", "hausse", "baisse"),
)
SPANISH = Terms(
    ".", ",",
    {"segment": ("actividad principal por producto",), "industry": ("actividad principal por sector",), "region": ("actividad principal por región",), "channel": ("actividad principal por canal de venta",),
     "stock": ("producción, ventas y existencias",), "customers": ("principales clientes",), "vendors": ("principales proveedores",), "statement": ("cuenta de resultados",), "end": ("informe de gestión",)},
    (("miles de millones", 10**9), ("millones", 10**6), ("miles de euros", 10**3), ("euros", 1)),
    (("variación de ingresos", "revenue_yoy"), ("variación de coste", "cost_yoy"), ("variación de margen", "margin_delta"), ("margen bruto", "gross_margin"), ("ingresos", "revenue"), ("coste de ventas", "cost")),
    ("aumento de",), ("descenso de",), ("puntos porcentuales", "puntos"), ("total", "ingresos", "margen bruto"),
    (("producción", "production"), ("ventas", "sales"), ("existencias", "stock")), {}, "total", ("interanual", "variación", "aumento", "descenso"),
)
CHINESE = Terms(
    ",", ".",
    {"segment": ("主营业务分产品情况", "分产品"), "industry": ("主营业务分行业情况", "分行业"), "region": ("主营业务分地区情况", "分地区"), "channel": ("主营业务分销售模式情况", "分销售模式"),
     "stock": ("产销量情况分析表", "产销量情况"), "customers": ("公司前五名客户", "前五名客户"), "vendors": ("公司前五名供应商", "前五名供应商"), "statement": ("合并利润表",), "end": ("产销量情况说明", "成本分析表", "管理层讨论与分析", "(2).", "(3).")},
    (("亿元", 10**8), ("百萬元", 10**6), ("百万元", 10**6), ("万元", 10**4), ("千元", 10**3), ("元", 1)),
    (("营业收入比上年增减", "revenue_yoy"), ("营业收入同比增减", "revenue_yoy"), ("营业成本比上年增减", "cost_yoy"), ("毛利率比上年增减", "margin_delta"), ("毛利率同比增减", "margin_delta"), ("毛利率", "gross_margin"), ("营业收入", "revenue"), ("营业成本", "cost")),
    ("增加",), ("减少",), ("个百分点",), ("合计", "主营业务", "营业收入", "毛利率", "单位", "百分点", "主要产品", "库存量"),
    (("生产量", "production"), ("销售量", "sales"), ("库存量", "stock")),
    {"pair": (r"前五名{who}(?:销售额|采购额)\s*{n}\s*(?P<unit>[亿万]?元)?\s*[，,；;]\s*占年度(?:销售|采购)总额\s*{n}\s*%",), "amount": (r"前五名{who}合计(?:销售|采购)金额\s*（?(?P<unit>元)?）?\s*{n}",),
     "share": (r"前五名{who}(?:合计)?(?:销售|采购)(?:额|金额)占年度(?:销售|采购)总额比例?\s*{n}\s*%", r"第一大{who}占比\s*{n}\s*%"),
     "related": (r"关联方(?:销售额|采购额)\s*{n}\s*(?:[亿万]?元)?\s*[，,；;]\s*占年度(?:销售|采购)总额\s*{n}\s*%",), "related_share": (r"关联方(?:销售额|采购额)占年度(?:销售|采购)总额比例\s*{n}\s*%",)},
    "合计", ("同比", "增长", "增减", "变动", "比上年同期", "本年比上年"),
)
LANGUAGES = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH, "es": SPANISH, "zh": CHINESE}
#: Who is meant by the five largest.
WHO = {"customers": r"(?:customers|kunden|clients?|clientes?|客户)", "vendors": r"(?:suppliers|lieferanten|fournisseurs?|proveedor(?:es)?|供应商)"}

Cell = tuple[str, int, str, str, str, Decimal | None, int]  # table, row, label, role, text, value, factor


_LETTER = re.compile(r"[^\W\d_]")
_HAN = "[\u4e00-\u9fff]"
#: Han characters that stand one by one.
_SPACED = re.compile(rf"(?<!{_HAN}){_HAN}(?: {_HAN}(?!{_HAN}))+")
_BLANKS, _DIGIT, _WORD = re.compile(r"[ \t\u00a0\u3000]+"), re.compile(r"\d"), re.compile(r"\w")
_POINT, _TAIL, _CENT = re.compile(r"(\d)\s*\.\s+(\d)|(\d)\s+\.\s*(\d)"), re.compile(r"(\d\.\d) (\d)(?=\s|%|$)"), re.compile(r"(\d)[ \u202f]?[%％]")


def repaired(line: str) -> str:
    """One blank between tokens, numbers put together again that were broken at their point or before their last digit, Han words without blanks."""
    line = _BLANKS.sub(" ", line).strip()
    if "." in line:
        line = _POINT.sub(lambda m: f"{m[1] or m[3]}.{m[2] or m[4]}", line)
        line = _TAIL.sub(r"\1\2", line)
    if "%" in line or "％" in line:
        line = _CENT.sub(r"\1%", line)
    return line if line.isascii() else _SPACED.sub(lambda m: m[0].replace(" ", ""), line)


def label_of(raw: str) -> str:
    """Without numbering and a leading "of which"."""
    raw = re.sub(r"^(?:\d+[.、)]|[(（]\d+[)）])\s*", "", raw.strip(" |/."))
    raw = re.sub(r"^(?:其中|of which|davon|dont|de los cuales)[:：]?\s*", "", raw).strip()
    return re.sub(rf"(?<={_HAN}) (?={_HAN})", "", raw)


def _opened(low: str, numbered: bool, terms: Terms) -> str | None:
    """The part whose title a line is, or, with numbers in it, begins with."""
    if len(low) > LONGEST_TITLE or (numbered and not low.startswith(terms.title_words)):
        return None
    return next((k for k, words in terms.titles.items() if any(low.startswith(w) if numbered else w in low for w in words)), None)


@lru_cache(maxsize=1)
def tables(text: str, terms: Terms) -> tuple[tuple[str, int, str, int], ...]:
    """The rows inside the tables of a text; the readers of one text follow each other, so it is cut into lines once."""
    return tuple(_tables(text, terms))


def _tables(text: str, terms: Terms) -> Iterator[tuple[str, int, str, int]]:
    """(table, row, line, factor of the unit) of the rows inside tables, wrapped rows joined; -1 for a row of column names."""
    table, factor, row, begun = "", 1, 0, ""
    for raw in text.split("\n"):
        line = repaired(raw)
        numbered = _DIGIT.search(line) is not None
        part = _opened(line.lower(), numbered, terms)
        if part and not (numbered and _first(terms.rows["metrics"], line)):
            if part != table:
                table, factor, row, begun = "" if part == "end" else part, 1, 0, ""
            if not numbered or part not in WHO:  # a sentence on the five largest is a title and a row
                continue
        if not table or not _WORD.search(line):
            continue
        if not numbered:
            unit = terms.unit(line)
            if unit and terms.only_unit(line):
                factor = unit
            elif _roles(line, terms) or sum(word in line.lower() for word, _ in terms.stock) >= 2:
                yield table, -1, line, factor
                begun = ""
            elif table in METRIC_TABLES or table == "stock":
                begun = f"{begun} {line}".strip() if len(begun) + len(line) < WRAP else ""
            continue
        yield table, row, f"{begun} {line}".strip(), factor
        begun, row = "", row + 1


def _roles(line: str, terms: Terms) -> list[str | None] | None:
    """Roles of the columns of a header, in order; None if it is no header. Filings of a language share their headers."""
    return _roles_once(line, terms) if len(line) <= LONGEST_HEADER else _roles_once.__wrapped__(line, terms)


@lru_cache(maxsize=256)
def _roles_once(line: str, terms: Terms) -> list[str | None] | None:
    low = line.lower()
    at: list[tuple[int, int, str]] = []
    for name, role in terms.roles:
        for m in re.finditer(re.escape(name), low):
            if not any(a <= m.start() < b for a, b, _ in at):
                at.append((m.start(), m.end(), role))
    return [role for _, _, role in sorted(at)] if len(at) >= 3 else None


def metric_rows(text: str, terms: Terms) -> Iterator[Cell]:
    """Cells of the tables of operations: by header where cells are piped, else the seven-column form, else, for a label that
    isn't there yet, the six-column form. A filing without a product table has its industries instead."""
    roles: list[str | None] | None = None
    seen: dict[str, set[str]] = {}
    short: list[tuple[str, int, str, int]] = []
    for table, row, line, factor in tables(text, terms):
        if table not in METRIC_TABLES:
            continue
        if row < 0:
            roles = _roles(line, terms) if "|" in line else None
            continue
        if line.startswith("|") and roles:
            label, *cells = (c.strip() for c in line.strip("|").split("|"))
            if len(cells) == len(roles):
                yield from _cells(table, row, label, zip(roles, cells), factor, terms, seen)
            continue
        found = _first(terms.rows["metrics"][:1], line)
        if found:
            yield from _cells(table, row, found[1]["label"], [(r, found[1][r]) for r in found[0]], factor, terms, seen)
        else:
            short.append((table, row, line, factor))
    for table, row, line, factor in short:
        found = _first(terms.rows["metrics"][1:], line)
        if found and label_of(found[1]["label"]) not in seen.get(table, ()):
            yield from _cells(table, row, found[1]["label"], [(r, found[1][r]) for r in found[0]], factor, terms, seen)


def _first(forms, line: str):
    return next(((roles, m) for roles, pattern in forms if (m := pattern.match(line))), None)


def _cells(table: str, row: int, raw: str, cells: Iterable[tuple[str | None, str]], factor: int, terms: Terms, seen: dict[str, set[str]]) -> Iterator[Cell]:
    label = label_of(raw)
    if not _LETTER.search(label) or any(j in label.lower() for j in terms.junk) or label in seen.setdefault(table, set()):
        return
    seen[table].add(label)
    for role, cell in cells:
        if role:
            yield table, row, label, role, cell, terms.value(cell), factor if role in AMOUNTS else 1


def stock_rows(text: str, terms: Terms) -> Iterator[Cell]:
    """Production, sales and stock of each product, or those of the whole company from a line each."""
    whole: dict[str, tuple[str, str, str]] = {}
    form = re.compile(rf"^(?P<name>\S+) +(?P<unit>{terms.measures}) +(?P<now>{terms.cell}) +(?P<was>{terms.cell}) +(?P<yoy>{terms.cell})$")
    rows: list[Cell] = []
    for table, row, line, _ in tables(text, terms):
        if table != "stock" or row < 0:
            continue
        m = form.match(line)
        role = next((r for w, r in terms.stock if m and m["name"].lower() == w), None)
        if role:
            whole[role] = (m["unit"], m["now"], m["yoy"])
            continue
        found = _first(terms.rows["stock"], line)
        if found:
            label = label_of(found[1]["label"])
            if _LETTER.search(label) and not any(j in label.lower() for j in terms.junk):
                rows += [("stock", row, label, r, found[1][r] if r.endswith("yoy") else f"{found[1][r]} {found[1]['unit']}", terms.value(found[1][r]), 1) for r in found[0]]
    if len(whole) == len(terms.stock):
        for role, (unit, now, yoy) in whole.items():
            yield "stock", 0, "whole", role, f"{now} {unit}", terms.value(now), 1
            yield "stock", 0, "whole", f"{role}_yoy", yoy, terms.value(yoy), 1
    else:
        yield from rows


def concentration(text: str, terms: Terms) -> Iterator[Cell]:
    """What the five largest customers and suppliers take: a sentence, lines of their own, or the total of the table; the largest from its first row."""
    lines: dict[str, list[str]] = {}
    factors: dict[str, int] = {}
    for table, row, line, factor in tables(text, terms):
        if table in WHO and row >= 0:
            lines.setdefault(table, []).append(line)
            factors[table] = factor
    n = rf"(-?{terms.number})"
    for table, rows in lines.items():
        whole, got = "\n".join(rows), {}
        for kind, names in (("pair", ("top_five_amount", "top_five_share")), ("amount", ("top_five_amount",)), ("share", ("top_five_share",)), ("related", ("related_amount", "related_share")), ("related_share", ("related_share",))):
            for pattern in terms.five.get(kind, ()):
                m = re.search(pattern.replace("{who}", WHO[table]).replace("{n}", n), whole, re.IGNORECASE)
                if m:
                    unit = m.groupdict().get("unit")
                    numbers = [g for g in m.groups() if g and g != unit]
                    for name, raw in zip(names, numbers):
                        got.setdefault(name, (raw, terms.unit(unit) if unit else 10**3 if " thousand" in pattern else factors[table]))
        total = re.search(rf"^{terms.total} *(?:/|--|—) *{n} +{n} *%? */?$", whole, re.IGNORECASE | re.MULTILINE)
        if total:
            got.setdefault("top_five_amount", (total[1], factors[table]))
            got.setdefault("top_five_share", (total[2], 1))
        first = re.search(rf"^1 +(\D\S*(?: \S+)*?) +{n} +{n} *%?(?: |$)", whole, re.MULTILINE)
        if first:
            got["largest_amount"] = (first[2], got.get("top_five_amount", ("", factors[table]))[1])
            got["largest_share"] = (first[3], 1)
        for role, (raw, value, factor) in sanitised({k: (raw, terms.value(raw), factor) for k, (raw, factor) in got.items()}).items():
            yield table, 0, table, role, raw, value, factor if role in AMOUNTS else 1


def sanitised(cells: dict[str, tuple[str, Decimal | None, int]]) -> dict[str, tuple[str, Decimal, int]]:
    """Shares outside 0 to 100 and amounts of nothing go; if neither the five nor the largest are left, all do."""
    out = {}
    for role, (raw, value, factor) in cells.items():
        if value is None or (role.endswith("share") and not 0 <= value <= 100) or (role in ("top_five_amount", "largest_amount") and value == 0):
            continue
        out[role] = (raw, value, factor)
    return out if any(r.startswith(("top", "largest")) for r in out) else {}


def statement_cells(text: str, terms: Terms) -> Iterator[Cell]:
    """This year's and the last year's figure of each row of the statement: note numbers and dates are no figures."""
    for table, row, line, factor in tables(text, terms):
        if table != "statement" or row < 0:
            continue
        m = re.match(r"(\D*?[^\W\d]) +(?=[\d(—–-])(.*)$", line)
        if not m:
            continue
        cells = [c for c in re.findall(terms.cell, m[2]) if not (terms.value(c) is not None and is_reference(c, terms))]
        for role, cell in zip(("current", "prior"), cells):
            yield "statement", row, label_of(m[1]), role, cell, terms.value(cell), factor


def is_reference(cell: str, terms: Terms) -> bool:
    """A note's number or part of a date: below 100, or a year, without separators, brackets or digits after the point."""
    bare = cell.strip()
    bare = bare if bare.startswith("(") else bare.rstrip(")")  # "(note 5)", but not "(5)"
    return bare.isdigit() and (int(bare) < 100 or 1900 <= int(bare) <= 2100)


def metric_with_growth(text: str, labels: Iterable[str], terms: Terms) -> tuple[str, Decimal | None, Decimal | None] | None:
    """(label, value in ones, growth in per cent) behind the first of the labels that a text holds. The value is the first number in the span behind
    the label that is no per cent, note or year, with its unit; growth is the per cent behind a word for change, else the
    last per cent, else what follows from a second number beside it in the same unit."""
    number = rf"\(?[-−]?{terms.number}\)?"
    words = "|".join(map(re.escape, terms.change))
    for label in labels:
        at = text.lower().find(label.lower())
        if at < 0:
            continue
        span = repaired(text[at + len(label) : at + len(label) + SPAN].split("\n")[0])
        plain = [m for m in re.finditer(number, span) if not re.match(r"\s?[%％]", span[m.end() :]) and not is_reference(m[0], terms)]
        values = [v for v in (terms.value(m[0]) for m in plain) if v is not None]
        factor = (terms.unit(span[plain[0].end() : plain[0].end() + 24]) if plain else None) or 1
        told = re.search(rf"(?:{words})[^-−\d]{{0,40}}([-−]?{terms.number})\s?[%％]", span, re.IGNORECASE)
        rates = re.findall(rf"([-−]?{terms.number})\s?[%％]", span)
        growth = terms.value(told[1]) if told else terms.value(rates[-1]) if rates else None
        if growth is None and len(values) >= 2 and values[1]:
            growth = ((values[0] - values[1]) / abs(values[1]) * 100).quantize(Decimal("0.000001"))
        return label, values[0] * factor if values else None, growth
    return None


def in_ten_thousands(value: Decimal | None, factor: int) -> Decimal | None:
    """An amount in ten thousands, to two places, halves away from zero."""
    return None if value is None else (value * factor / 10_000).quantize(Decimal("0.01"), ROUND_HALF_UP)


Reader = Callable[[str, Terms], Iterable[Cell]]
_CELLS = pa.schema([("doc_id", pa.string()), ("section", pa.string()), ("line", pa.int64()), ("label", pa.string()), ("metric", pa.string()), ("cell", pa.string()), ("value", pa.float64()), ("normalized", pa.float64())])


#: A batch of texts holds many rows: so many are given on at once.
ROWS_AT_ONCE = 20_000


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[str, str | None, str | None]]:
    """(doc_id, lang, text) one by one; only the text that is read becomes a Python value."""
    for row in zip(*(batch.column(c) for c in ("doc_id", "lang", "text"))):
        yield tuple(v.as_py() for v in row)


@lru_cache(maxsize=16)
def terms_of(lang: str | None) -> Terms:
    return LANGUAGES.get(lang or "", ENGLISH)


def cells_of(filings: DataFrame, *readers: Reader) -> DataFrame:
    """(doc_id, section, line, label, metric, cell, value in ones, value in ten thousands) that the readers find in `filings` (doc_id, lang, text)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc, lang, text in texts_of(batch):
                for reader in readers:
                    for table, row, label, role, cell, value, factor in reader(text or "", terms_of(lang)):
                        scaled = in_ten_thousands(value, factor) if role in AMOUNTS else None
                        found.append((doc, table, row, label, role, cell, None if value is None else float(value * factor), None if scaled is None else float(scaled)))
                if len(found) >= ROWS_AT_ONCE:
                    yield batch_of(found, _CELLS)
                    found = []
            yield batch_of(found, _CELLS)

    return filings.select("doc_id", "lang", "text").mapInArrow(read, "doc_id string, section string, line long, label string, metric string, cell string, value double, normalized double")


def growth_of(filings: DataFrame, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, label, value, growth) of the first of the language's `labels` in the discussion part of each filing that has one."""
    schema = pa.schema([("doc_id", pa.string()), ("label", pa.string()), ("value", pa.float64()), ("growth", pa.float64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, lang, text in texts_of(batch):
                terms = terms_of(lang)
                low = (text or "").lower()
                at = max((low.rfind(w) for w in terms.titles["end"]), default=-1)
                got = metric_with_growth((text or "")[max(at, 0) :], labels.get(lang or "", ()), terms)
                if got:
                    found.append((doc, got[0], *(None if v is None else float(v) for v in got[1:])))
            yield batch_of(found, schema)

    return filings.select("doc_id", "lang", "text").mapInArrow(read, "doc_id string, label string, value double, growth double")
