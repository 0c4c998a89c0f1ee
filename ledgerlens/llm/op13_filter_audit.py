"""Interaction audit of document filters by Walsh-Hadamard transform.

Five filters are tried on every document; which of them it fails is a mask of five bits. Instead of one pass for
each order in which the filters could be applied, 32 signed parity sums are aggregated once for each part and label:
the sum for a set S adds +1 for a document that fails an even number of the filters of S and -1 for an odd
number. The transform is its own inverse up to a factor of 32, so the sums give back exactly how many documents have
each mask. From those 32 cells every order is evaluated: what a filter removes after others is the cells that fail it
and none of them. A filter removes a document in an order if it comes first among those that the document fails, which
for k failures is so in 120 / k of the 120 orders: the filter's Shapley sum in closed form.

Filters (`failures`): A under 200 words, B under half of the words distinct, C over 2 % capitals, D a sign of
`#$%&*|`, E a text that a smaller id has too, anywhere in the table. Texts meet by their SHA-256 digest: rows of one
text fail A to D alike, so they are counted for each (digest, part, label) before they are shuffled by digest; however
many copies a text has, a task sees one row for each part and label.

Defined results: a null text is the empty text; a null source is the part ''; a null id is larger than all others and
no null id is smaller than another; rows that repeat an id are documents of their own, and none of them is smaller than
the other; several label rows of one id count as one, good if any has quality 1, toxic if any has toxic 1;
documents without labels are neither. Other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SIGNS = b"#$%&*|"
#: Each id's labels are dealt over so many keys, so an id or null that many rows carry is not one task.
SALTS = 8
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_FAILED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32()), ("salt", pa.int32())])


def mask_of(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a UTF-8 text of so many code points fails."""
    words = text.split()  # bytes are split at blanks, tabs and line ends of ASCII only
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * n_chars) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest of the text, mask of A to D, salt) of every document."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            sizes, masks, digests = batch.column("n").to_pylist(), [], []
            for text, n in zip(batch.column("text"), sizes):
                raw = text.as_py()
                masks.append(mask_of(raw, n))
                digests.append(hashlib.sha256(raw).digest())
            salts = pa.array([(seen + i) % SALTS for i in range(batch.num_rows)], pa.int32())
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32()), salts], schema=_FAILED)

    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, text.cast("binary").alias("text"), F.length(text).alias("n"))
    return rows.mapInArrow(measure, "doc_id long, part string, digest binary, mask int, salt int")


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """`failed` with 0 or 1 for `good` and `toxic`."""
    of_id = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of_id = of_id.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    none = {"good": 0, "toxic": 0}
    # no estimate knows that each id is there once for every salt, so this side may not be sent through the driver
    return failed.join(of_id.hint("merge"), ["doc_id", "salt"], "left").fillna(none)


def cells(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): documents by all five filters, E among them."""
    last = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id")
    of_text = ["digest", "mask", "part", "good", "toxic"]
    once = rows.groupBy(*of_text, "doc_id", last, "salt").agg(F.count("*").alias("n"))
    once = once.groupBy(*of_text, "id").agg(F.sum("n").alias("n"))
    groups = once.groupBy(*of_text).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("head"))
    first = groups.groupBy("digest").agg(F.min("head.id").alias("first"))
    whole = groups.join(first, "digest")
    own = F.when(F.col("head.id") == F.col("first"), F.col("head.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n"))))
    return whole.select("part", "good", "toxic", split.alias("c")).select("part", "good", "toxic", "c.mask", "c.n")


def _sign(a: str, b: str) -> str:
    return f"(1 - 2 * (bit_count({a} & {b}) % 2))"


def parity_sums(masks: DataFrame) -> DataFrame:
    """(part, label, sums) of the labels `all`, `good` and `toxic`: the sum for set s adds n with the sign of the parity of `mask & s`."""
    label = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("good") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))).alias("label")
    sums = (F.sum(F.expr(f"n * {_sign('mask', str(s))}")) for s in range(MASKS))
    return masks.select("part", "mask", "n", label).groupBy("part", "label").agg(F.array(*sums).alias("sums"))


def inverted(sums: DataFrame) -> DataFrame:
    """(part, label, cells): how many documents have each mask, by the inverse transform."""
    every = f"sequence(0, {MASKS - 1})"
    return sums.select("part", "label", F.expr(f"transform({every}, m -> aggregate({every}, 0L, (x, s) -> x + {_sign('m', 's')} * sums[s]) div {MASKS})").alias("cells"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included."""
    by_label = inverted(parity_sums(cells(labelled(failures(docs), labels))))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    of_label = (F.coalesce(F.any_value(F.when(F.col("label") == name, F.col("cells")), True), none).alias(name[0]) for name in ("all", "good", "toxic"))
    parts = by_label.groupBy("part").agg(*of_label)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("_at", "_filter"))
    bits = " + ".join(f"IF(instr(substr(filter_order, 1, _at), '{f}') > 0, {1 << i}, 0)" for i, f in enumerate(FILTERS))
    steps = steps.withColumn("_bit", F.expr(f"1 << (ascii(_filter) - {ord(FILTERS[0])})")).withColumn("_before", F.expr(bits))

    def over(array: str, where: str, weight: str = "1") -> str:
        return f"aggregate(sequence(0, {MASKS - 1}), 0L, (n, m) -> n + IF({where}, {array}[m] * {weight}, 0L))"

    here = "(m & _bit) <> 0 AND (m & _before) = 0"
    return steps.selectExpr(
        "part",
        "filter_order",
        "CAST(_at + 1 AS INT) AS step",
        f"{over('a', '(m & (_bit | _before)) = 0')} AS kept",
        f"{over('a', here)} AS removed",
        f"{over('a', '(m & _bit) <> 0 AND (m & _before) <> 0')} AS redundant",
        "a[_bit] AS unique_fails",
        f"{over('g', here)} AS good_lost",
        f"{over('t', here)} AS toxic_lost",
        f"{over('a', '(m & _bit) <> 0', 'CAST(120 div bit_count(m) AS BIGINT)')} AS shapley",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


#: Every order applied to the masks of all documents, one after another.
ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
    SELECT d.doc_id, part,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), min(d.doc_id) OVER (PARTITION BY text) IS NOT NULL)] AS fails
    FROM d
), l AS (
    SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), g AS (
    SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), o AS (
    SELECT a || b || c || e || h AS filter_order
    FROM (SELECT unnest(string_split('A,B,C,D,E', ',')) AS a) CROSS JOIN (SELECT unnest(string_split('A,B,C,D,E', ',')) AS b) CROSS JOIN (SELECT unnest(string_split('A,B,C,D,E', ',')) AS c)
        CROSS JOIN (SELECT unnest(string_split('A,B,C,D,E', ',')) AS e) CROSS JOIN (SELECT unnest(string_split('A,B,C,D,E', ',')) AS h)
    WHERE len(list_distinct([a, b, c, e, h])) = 5
), w AS (
    -- the step at which each kind of document goes, 6 if it stays
    SELECT part, fails, good, toxic, n, filter_order, list_min([CASE WHEN fails[k] THEN instr(filter_order, substr('ABCDE', k, 1)) ELSE 6 END for k in [1, 2, 3, 4, 5]]) AS gone
    FROM g CROSS JOIN o
), r AS (
    SELECT part, filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS k,
        sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails[ascii(substr(filter_order, step, 1)) - 64] AND gone < step THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails[ascii(substr(filter_order, step, 1)) - 64] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN gone = step AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
    FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM r
"""
