"""Anchoring filed facts in the text of filings (X14): a numeric band join with first-block order.

A fact is a cell as a data service delivers it, rounded to the decimals of its unit; the filing prints the same amount in other
units. A fact's anchor is the first block, in order, with a row that names the fact's label and prints an amount
within half a unit of the cell's last place, or the cell's very digits. Facts without one are kept, with the reason.

Amounts meet by value, not by pairs: for each precision that the facts of their document and label have, the amounts of the text are put into bands of that width, and a
fact looks into the one or two bands that its tolerance touches, an equality join on document, label, precision and band.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filings import ROWS_AT_ONCE, Terms, batch_of, is_reference, repaired, terms_of, texts_of
from .filings import _opened as opened

#: Powers of ten of the widths of bands, in ten-thousandths of a unit of currency.
LEVELS = tuple(range(0, 14))
EXCERPT = 240


def band_join(facts: DataFrame, amounts: DataFrame, by: list[str]) -> DataFrame:
    """Facts (*by, value, tolerance, ...) joined to amounts (*by, amount, ...) with |value - amount| <= tolerance; all longs, columns otherwise distinct."""
    level = F.ceil(F.log10(F.greatest(2 * F.col("tolerance"), F.lit(1)).cast("double")))
    level = F.least(F.greatest(level, F.lit(LEVELS[0])), F.lit(LEVELS[-1])).cast("int")
    band = lambda v, w: F.expr(f"({v} - pmod({v}, {w})) div {w}")
    wide = facts.withColumn("_level", level).withColumn("_width", F.pow(F.lit(10.0), "_level").cast("long"))
    low, high = band("(value - tolerance)", "_width"), band("(value + tolerance)", "_width")
    probes = wide.withColumn("_band", F.explode(F.sequence(low, high))).drop("_width")  # two at most, as long as tolerances stay within the widest level
    at = amounts.join(wide.select(*by, "_level", "_width").distinct(), by)
    at = at.withColumn("_band", band("amount", "_width")).drop("_width")
    met = probes.join(at, [*by, "_level", "_band"]).where(F.abs(F.col("value") - F.col("amount")) <= F.col("tolerance"))
    return met.drop("_level", "_band")


def blocks_of(text: str, terms: Terms) -> Iterator[tuple[int, str, list[str]]]:
    """(order, part, lines) of the parts of a filing, each from its title to the next."""
    order, part, lines = 0, "", []
    for raw in text.split("\n"):
        line = repaired(raw)
        now = opened(line.lower(), re.search(r"\d", line) is not None, terms)
        if now and now != part:
            if lines:
                yield order, part, lines
            order, part, lines = order + 1, now, []
        if line:
            lines.append(line)
    if lines:
        yield order, part, lines


def amounts_of(text: str, terms: Terms, labels: dict[str, str]) -> Iterator[tuple[int, str, str, int | None, str, str, str, int]]:
    """(order, part, metric, amount in ten-thousandths, digits, excerpt, hash of the block, place in the text) of the numbers in rows that name a label; the
    amount is none for a row without numbers."""
    place = 0
    for order, part, lines in blocks_of(text, terms):
        factor = next((terms.unit(x) for x in lines if not re.search(r"\d", x) and terms.unit(x) and terms.only_unit(x)), None)
        whole = hashlib.sha256(" ".join(lines).encode()).hexdigest()
        for line in lines:
            for metric, label in labels.items():
                at = line.lower().find(label.lower())
                if at < 0:
                    continue
                tail = line[at + len(label) :]
                found = False
                for m in re.finditer(rf"\(?[-−]?{terms.number}\)?", tail):
                    value = terms.value(m[0])
                    if value is None or is_reference(m[0], terms) or re.match(r"\s?[%％]", tail[m.end() :]):
                        continue
                    own = terms.unit(tail[m.end() : m.end() + 24]) or factor or 1
                    found, place = True, place + 1
                    yield order, part, metric, int(value * own * 10_000), re.sub(r"\D", "", m[0]), line[:EXCERPT], whole, place
                if not found:
                    yield order, part, metric, None, "", line[:EXCERPT], whole, place


_AMOUNTS = pa.schema([("doc_id", pa.string()), ("block", pa.int32()), ("part", pa.string()), ("metric", pa.string()), ("amount", pa.int64()), ("digits", pa.string()), ("excerpt", pa.string()), ("block_hash", pa.string()), ("place", pa.int32())])


def text_amounts(filings: DataFrame, labels: dict[str, dict[str, str]]) -> DataFrame:
    """The amounts of `filings` (doc_id, lang, text) beside the labels of their language: metric to label."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc, lang, text in texts_of(batch):
                found += ((doc, *row) for row in amounts_of(text or "", terms_of(lang), labels.get(lang or "", {})) if row[3] is None or abs(row[3]) < 2**62)
                if len(found) >= ROWS_AT_ONCE:
                    yield batch_of(found, _AMOUNTS)
                    found = []
            yield batch_of(found, _AMOUNTS)

    schema = "doc_id string, block int, part string, metric string, amount long, digits string, excerpt string, block_hash string, place int"
    return filings.select("doc_id", "lang", "text").mapInArrow(read, schema)


def anchored(facts: DataFrame, amounts: DataFrame) -> DataFrame:
    """`facts` (doc_id, metric, value, tolerance, digits) with the part, amount, excerpt and hash of their first block, or the reason why there is none."""
    named = amounts.groupBy("doc_id", "metric").agg(F.count("*").alias("rows"))
    there = amounts.where("amount IS NOT NULL")
    # the first is found by light rows; what is printed there is fetched afterwards, once
    by, light = ["doc_id", "metric"], ["block", "place", "part", "amount"]
    spot = F.struct(*light).alias("spot")
    near = band_join(facts.drop("digits"), there.select(*by, *light), by)
    same = facts.where("digits <> ''").join(there.select(*by, "digits", *light), [*by, "digits"])
    hits = near.select(*by, spot).union(same.select(*by, spot))
    first = hits.groupBy(*by).agg(F.min("spot").alias("spot")).select(*by, "spot.*")
    printed = there.groupBy(*by, *light).agg(F.min(F.struct("excerpt", "block_hash")).alias("printed"))
    found = first.join(printed, [*by, *light]).select(*by, F.col("block").alias("spot"), "part", "amount", "printed.*")
    out = facts.join(found, by, "left").join(named, by, "left")
    reason = F.when(F.col("spot").isNotNull(), "anchored").when(F.col("rows") > 0, "no_amount").otherwise("no_label")
    return out.select("doc_id", "metric", "value", reason.alias("status"), "part", "amount", "excerpt", "block_hash")
