"""Topic clusters over items of several sources.

Items of one run (here: a language and a week) are taken in order, topic by topic in the order in which topics first
appear. The first item left leads a cluster and walks on through the items left: items of other sources join it
whatever they say, items of its own source if their words are alike, until the cluster has `MOST` items.

Every item belongs to the first topic, in that order, of those it has, since each topic clusters all items left to it.
Alike are word sets with a Dice coefficient of 0.55 or more. The walk is a stream over an item's number, source and hashes of its words,
sorted by group, and compares what a leader meets: an item of its source, or, when it takes the lead, the items that the leaders
before it have passed over, which are all of one source; only of these that share one of their rarest words. So no pairs of items
are made beforehand, which would grow with the square of a group. A task holds the items passed over, and no text.
`similar_classes` gives the whole relation, for those who need it.
"""

from __future__ import annotations

from array import array
from collections import Counter, deque
from collections.abc import Collection, Iterable, Iterator, Mapping
from heapq import merge
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import written

MOST = 15
#: Dice coefficient 0.55 in whole numbers: 2 common / (a + b) >= 11 / 20.
_UP, _DOWN = 11, 20


def similar_classes(items: DataFrame, by: list[str]) -> DataFrame:
    """(*by, class, near): for each class of equal word sets among items of equal `by`, the other classes that are alike."""
    classes = written(items.where(F.size("words") > 0).groupBy(*by, "class").agg(F.first("words").alias("words")))
    # words in more than a thousandth of all classes: a bounded table, as a class has few words
    least = classes.count() / 1000
    frequent = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") > least)
    words = classes.select(*by, "class", F.size("words").alias("n"), F.explode("words").alias("word")).join(F.broadcast(frequent), "word", "left")
    rarest = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")))["word"]
    sets = written(words.groupBy(*by, "class", "n").agg(rarest.alias("w")))
    share = F.ceil(F.col("n") * _UP / (2 * _DOWN - _UP))  # so many words at least are in both of two such sets
    # pairs meet without their words, and no side is sent to the driver: a class has a row for every word of its prefix, which no estimate knows
    prefix = sets.select(*by, "class", "n", F.posexplode(F.slice("w", F.lit(1), (F.col("n") - share + 1).cast("int"))).alias("at", "word"))
    a, b = prefix.alias("a"), prefix.hint("merge").alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    met = a.join(b, [*same, F.col("a.word") == F.col("b.word"), F.col("a.class") < F.col("b.class")])
    # words before the one they meet at, this one, and those behind it: no more can be in both
    most = F.least("a.at", "b.at") + 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) - 1
    met = met.where(2 * _DOWN * most >= _UP * (F.col("a.n") + F.col("b.n"))).select(*(F.col(f"a.{c}").alias(c) for c in by), F.col("a.class").alias("x"), F.col("b.class").alias("y")).distinct()
    for end in ("x", "y"):
        of = sets.select(*(F.col(c).alias(f"{c}_of") for c in by), F.col("class").alias(end), F.col("w").alias(f"w_{end}")).hint("merge")
        met = met.join(of, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by] + [met[end] == of[end]]).drop(of[end], *(f"{c}_of" for c in by))
    common, sizes = F.size(F.array_intersect("w_x", "w_y")), F.size("w_x") + F.size("w_y")
    near = met.where(2 * _DOWN * common >= _UP * sizes).select(*by, "x", "y")
    both = near.union(near.select(*by, F.col("y"), F.col("x"))).toDF(*by, "class", "other")
    return both.groupBy(*by, "class").agg(F.collect_list("other").alias("near"))


def _alike(a: frozenset[int], words: Collection[int]) -> bool:
    return bool(a) and bool(words) and 2 * _DOWN * len(a.intersection(words)) >= _UP * (len(a) + len(words))


class Walk:
    """Clusters of one group, item by item in order. `often`: how often words occur somewhere, which makes for short lists and changes no result."""

    def __init__(self, most: int = MOST, often: Mapping[int, int] | None = None):
        self.most = most
        self.often = often or {}
        self.waiting: dict[int, tuple[str, int | None]] = {}  # passed over, in order, all of one source
        self.of_class: dict[int, deque[int]] = {}
        self.words: dict[int, array[int]] = {}  # of each class that waits
        self.classes: dict[int, set[int]] = {}  # that wait and have the word among their rarest
        self.seed: tuple[int, str, int | None, frozenset[int]] | None = None
        self.size = 0
        self.out: list[tuple[int, int]] = []

    def _rarest(self, words: Collection[int]) -> list[int]:
        """Two sets that are alike share one of these."""
        share = -(-len(words) * _UP // (2 * _DOWN - _UP))  # so many words at least are in both
        return sorted(words, key=lambda w: (self.often.get(w, 0), w))[: len(words) - share + 1]

    def _lead(self, seq: int, source: str, kind: int | None, words: Collection[int]) -> None:
        mine = frozenset(words)
        self.seed, self.size = (seq, source, kind, mine), 1
        self.out.append((seq, seq))
        if kind is None:
            return
        # of those passed over, which have the same source, the ones that are alike come first
        met = set().union(*(self.classes.get(w, ()) for w in self._rarest(mine))) if self.classes else set()
        near = [kind, *(k for k in met if k != kind and _alike(mine, self.words[k]))]
        for other in list(islice(merge(*(self.of_class.get(k, ()) for k in near)), self.most - 1)):
            self._forget(other)
            self._take(other)

    def _take(self, seq: int) -> None:
        self.out.append((seq, self.seed[0]))
        self.size += 1
        if self.size >= self.most:
            self.seed = None

    def _pass_over(self, seq: int, source: str, kind: int | None, words: Collection[int]) -> None:
        self.waiting[seq] = (source, kind)
        if kind is None:
            return
        if kind not in self.of_class:
            self.of_class[kind], self.words[kind] = deque(), array("q", words)
            for w in self._rarest(words):
                self.classes.setdefault(w, set()).add(kind)
        self.of_class[kind].append(seq)

    def _forget(self, seq: int) -> Collection[int]:
        """The words of an item that waits no more."""
        kind = self.waiting.pop(seq)[1]
        if kind is None:
            return ()
        words = self.words[kind]
        self.of_class[kind].remove(seq)
        if not self.of_class[kind]:
            del self.of_class[kind], self.words[kind]
            for w in self._rarest(words):
                self.classes[w].discard(kind)
                if not self.classes[w]:
                    del self.classes[w]
        return words

    def _next_leader(self) -> None:
        seq = next(iter(self.waiting))
        source, kind = self.waiting[seq]
        self._lead(seq, source, kind, self._forget(seq))

    def add(self, seq: int, source: str, kind: int | None, words: Collection[int]) -> None:
        while self.seed is None and self.waiting:
            self._next_leader()
        if self.seed is None:
            self._lead(seq, source, kind, words)
        elif source != self.seed[1] or (kind is not None and (kind == self.seed[2] or _alike(self.seed[3], words))):
            self._take(seq)
        else:
            self._pass_over(seq, source, kind, words)

    def end(self) -> None:
        while self.waiting:
            self._next_leader()


def leader_clusters(items: DataFrame, group: list[str]) -> DataFrame:
    """(seq, seed) of `items` (*group, seq, source, class, words): the leader of each item's cluster."""
    schema = pa.schema([("seq", pa.int64()), ("seed", pa.int64())])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, often = None, None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            rows = batch.to_pylist()
            if often is None:
                often = {w: n for w, n in Counter(w for row in rows for w in row["words"]).items() if n > 1}
            for row in rows:
                key = tuple(row[g] for g in group)
                if now is None or key != of:
                    if now is not None:
                        now.end()
                        out += now.out
                    now, of = Walk(often=often), key
                now.add(row["seq"], row["source"], row["class"], row["words"])
            out += now.out if now else []
            if now:
                now.out = []
            yield _batch(out, schema)
        if now is not None:
            now.end()
            yield _batch(now.out, schema)

    hashes = F.transform(F.array_distinct(F.coalesce("words", F.array().cast("array<string>"))), lambda w: F.xxhash64(w))
    light = items.select(*group, "seq", "source", "class", hashes.alias("words"))
    return light.repartition(*group).sortWithinPartitions(*group, "seq").mapInArrow(walk, "seq long, seed long")


def _batch(rows: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], schema=schema)


def first_topics(items: DataFrame, run: list[str]) -> DataFrame:
    """`items` with `topic`: of each item's `topics` (numbers in the order of the list) the one that appears first in its run."""
    each = items.select(*run, "seq", F.explode("topics").alias("topic"))
    first = each.groupBy(*run, "topic").agg(F.min("seq").alias("first"))
    order = first.groupBy(*run).agg(F.sort_array(F.collect_list(F.struct("first", "topic")))["topic"].alias("order"))  # at most as many as topics
    own = items.join(order, [items[c].eqNullSafe(order[c]) for c in run]).drop(*(order[c] for c in run))
    return own.withColumn("topic", F.expr("filter(order, x -> array_contains(topics, x))[0]")).drop("order")


def consolidated(items: DataFrame, run: list[str]) -> DataFrame:
    """One row for each cluster of `items` (*run, seq, source, quality, topics, words), led by its best item (ties: the first)."""
    items = first_topics(items, run)
    items = items.withColumn("class", F.when(F.size("words") > 0, F.xxhash64(F.array_sort("words"))))
    led = leader_clusters(items, [*run, "topic"])
    whole = items.join(led, "seq").groupBy(*run, "topic", "seed")
    member = F.struct((-F.col("quality")).alias("q"), F.col("seq"), F.col("source"))
    return whole.agg(F.sort_array(F.collect_list(member)).alias("m"), F.min_by("topics", member).alias("topics")).select(  # at most 15
        *run, "topic", "seed", F.col("m")[0]["seq"].alias("best"), (-F.col("m")[0]["q"]).alias("quality"), "topics",
        F.size("m").alias("members"), F.expr("transform(slice(m, 2, size(m)), x -> concat(x.source, ':', x.seq))").alias("others"),
        F.array_sort(F.array_distinct("m.source")).alias("sources"),
    )
