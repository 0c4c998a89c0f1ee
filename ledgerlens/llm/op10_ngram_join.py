"""N-gram Jaccard self-join of documents by chosen paths.

A document is the set of its five-word shingles (lower-cased words of letters and digits; a
shorter text has one shingle of all its words). Documents with equal sets form one class.
The join finds all pairs of classes whose sets have a Jaccard similarity of 0.8 or more:

1. One pass over the texts picks, in each of several runs, the tokens t of a set x with
   r(run, t) < 1 / (0.8 |x|). Each such token is a bucket of level 1. From each bucket on the
   set picks tokens again by r(path, t), for the next level. Similar sets tend to pick the
   same tokens; others soon part.
2. A bucket with more than `SMALL` classes or `WEIGHT` tokens is split into its sub-buckets, level by
   level, until all are small: the first `LEVELS` levels come from the first pass, deeper ones from the
   texts of the members of large buckets alone. Members of a bucket that share a common passage and little
   else pick ever fewer tokens together, so their buckets die out. A bucket whose members agree with one of
   them on `ALIKE` of the minima or more is a group of near copies, which no path parts: it isn't split but dealt
   over pairs of blocks, so no task holds much more than a small bucket and nothing is dropped.
   `recall()` gives the chance that a pair meets; there are as many runs as `TARGET` needs at
   the first `LEVELS` levels, and sets that went deeper get as many more as it needs there.
3. Small buckets are compared by brute force: first on sketches of minima, then, for those
   with a possible partner, on whole sets. A pair belongs to the smallest bucket that both
   share, so it is counted once. A bucket gives each member's number of links and the root
   of its group in that bucket, never the pairs themselves.
4. Roots are joined to components over all buckets.

A class is told by the hash of its set, and represented by one (id, hash of the raw text), never by an
id alone: ids may be null or shared by different texts. Texts are never shuffled, only the sets
of classes that have a possible partner.

Defined results: null and empty texts, and texts without any word, have no shingles, so no
links; equal ones form a class. Repeated rows and ties are copies of one class. Ids may be
null. Only doc_id and text are read; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, sorted_groups
from .components import connected_components
from .textnum import mix, shingles, word_hashes

K = 5
SIMILARITY = 0.8
TARGET = 0.999
LEVELS = 3
SKETCH = 24
#: Of SKETCH minima, this many must agree for a pair to be verified; a pair of similarity 0.8 has
#: fewer with probability below 1e-4.
AGREE = 11
SMALL = 1000
WEIGHT = 4_000_000
ALIKE = 0.6
#: Large buckets of deeper levels, if there ever are any, are dealt over blocks like near copies.
DEEPEST = 40
_SLICE = 1 << 16


def recall(runs: int, levels: int = LEVELS) -> float:
    """The chance that a pair of similarity 0.8 meets in a bucket of the given level, at worst
    (one set within the other: a token of theirs is picked by both once per level on average)."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return 1 - (1 - alive) ** runs


def runs_for(target: float = TARGET, levels: int = LEVELS) -> int:
    """The least number of runs with that recall."""
    return math.ceil(math.log(1 - target) / math.log(1 - recall(1, levels)))


RUNS = runs_for()


def _seeds(lo: int, hi: int) -> np.ndarray:
    return mix(np.arange(lo + 1, hi + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _picked(paths: np.ndarray, tokens: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sub-paths and the index of the path that each continues."""
    subs, parents = [], []
    for lo in range(0, tokens.size, _SLICE):
        v = _spread(paths[:, None] ^ tokens[None, lo : lo + _SLICE])
        at, j = np.nonzero(v < limit)
        subs.append(_spread(v[at, j] + np.uint64(0xA24BAED4963EE407)))
        parents.append(at)
    return np.concatenate(subs), np.concatenate(parents)


def _limit(tokens: np.ndarray) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(2**64 / (SIMILARITY * tokens.size))))


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """The minima of a non-empty set under `SKETCH` hashes."""
    least = np.full(SKETCH, 2**64 - 1, np.uint64)
    for lo in range(0, tokens.size, _SLICE):
        np.minimum(least, _spread(tokens[None, lo : lo + _SLICE] ^ _seeds(0, SKETCH)[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def paths_of(tokens: np.ndarray, first_run: int, runs: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The buckets of a non-empty set on each of the first levels, and the parents of the deeper ones."""
    limit, seeds, first = _limit(tokens), _seeds(first_run, first_run + runs), []
    for lo in range(0, tokens.size, _SLICE):
        v = _spread(tokens[None, lo : lo + _SLICE] ^ seeds[:, None])
        run, j = np.nonzero(v < limit)
        first.append(_spread(v[run, j] + seeds[run]))
    paths, parents = [np.concatenate(first)], []
    for _ in range(LEVELS - 1):
        subs, at = _picked(paths[-1], tokens, limit)
        paths.append(subs)
        parents.append(at)
    return paths, parents


def _key(tokens: np.ndarray, text: str) -> bytes:
    if tokens.size:
        return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return hashlib.blake2b(b"text" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The set of shingles of each text, sorted."""
    for _, words, first in word_hashes(texts):
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(shingles(words[a:b], K))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t or "").lower() for t in batch.column("text").to_pylist()]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *(p.size for p in parts)])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    values = values.view(np.int64) if kind == pa.int64() else values.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


_PATHS = [("p1", pa.int64()), ("p2", pa.int64()), ("a2", pa.int32()), ("p3", pa.int64()), ("a3", pa.int32())]
_PATHS_SQL = "p1 array<long>, p2 array<long>, a2 array<int>, p3 array<long>, a3 array<int>"
_SKETCHED = f"doc_id long, text_hash binary, key binary, n int, sketch binary, {_PATHS_SQL}"


class _Paths:
    """Columns of buckets and parents."""

    def __init__(self) -> None:
        self.columns: list[list[np.ndarray]] = [[] for _ in _PATHS]

    def add(self, tokens: np.ndarray, first_run: int, runs: int) -> None:
        (p1, p2, p3), (a2, a3) = paths_of(tokens, first_run, runs) if tokens.size else ([tokens] * 3, [tokens] * 2)
        for column, x in zip(self.columns, (p1, p2, a2, p3, a3), strict=True):
            column.append(x)

    def arrays(self) -> list[pa.Array]:
        return [_lists(c, kind) for c, (_, kind) in zip(self.columns, _PATHS, strict=True)]


def _few(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts: texts, sets and paths of a whole batch as Python values may be large."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        texts = _texts(batch)
        keys, n, minima, paths = [], [], [], _Paths()
        for text, tokens in zip(texts, _sets(texts), strict=True):
            keys.append(_key(tokens, text))
            n.append(tokens.size)
            minima.append(sketch_of(tokens).tobytes() if tokens.size else b"")
            paths.add(tokens, 0, RUNS)
        yield pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(minima, pa.binary()), *paths.arrays()],
            names=["doc_id", "text_hash", "key", "n", "sketch", *(c for c, _ in _PATHS)],
        )


def _place(key: bytes) -> int:
    return int.from_bytes(key[:3], "big")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2^24 bits (2 MB, however many keys there are), those at the places of the keys set."""
    place = F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("long") + 1
    rows = keys.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(1 << 21, np.uint8)
    for r in rows.collect():  # at most 512
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _whole_sets(bits):
    """key, n and tokens of the texts whose class may be wanted, by the bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "tokens"]
        for batch in _few(batches):
            texts = _texts(batch)
            out, size = [], 0
            for text, tokens in zip(texts, _sets(texts), strict=True):
                key = _key(tokens, text)
                at = _place(key)
                if tokens.size and bits.value[at >> 3] >> (at & 7) & 1:
                    out.append((key, tokens.size, tokens.tobytes()))
                    size += tokens.nbytes
                if size > 1 << 24:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.binary()), strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.binary()), strict=True)], names=names)

    return run


def _more_paths(more: int):
    """The buckets of `more` further runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = _Paths()
            for (tokens,) in _rows(batch, "tokens"):
                paths.add(np.frombuffer(tokens, np.uint64), RUNS, more)
            yield pa.record_batch([batch.column("key"), batch.column("n"), batch.column("sketch"), *paths.arrays()], names=["key", "n", "sketch", *(c for c, _ in _PATHS)])

    return run


def _deeper(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sub-buckets of each class in the large buckets it is in."""
    for batch in batches:
        out: list[tuple] = []
        for key, n, hot, tokens in _rows(batch, "key", "n", "hot", "tokens"):
            tokens = np.frombuffer(tokens, np.uint64)
            subs, _ = _picked(np.array(hot, np.int64).view(np.uint64), tokens, _limit(tokens))
            out += [(key, n, b) for b in subs.view(np.int64).tolist()]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["key", "n", "bucket"])


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share (the diagonal is left 0)."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [s.size for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(shared.sum())
    for lo in range(0, total, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        grid = np.zeros((m, min(columns, total - lo)), np.float32)
        grid[owner[a:b], column[a:b] - lo] = 1
        out += grid @ grid.T
    np.fill_diagonal(out, 0)
    return out


def _may_pair(group: dict[str, list], sizes: np.ndarray) -> np.ndarray:
    """Which pairs this bucket owns and compares, by size and by block."""
    bucket = group["bucket"][0]
    before = [np.array([x for x in xs if x < bucket], np.int64) for xs in group["buckets"]]
    ok = common_counts(before) == 0 if any(b.size for b in before) else np.ones((len(before),) * 2, bool)
    np.fill_diagonal(ok, False)
    ok &= sizes[:, None] >= SIMILARITY * sizes[None, :] - 1e-9
    ok &= ok.T
    if group["lo"][0] != group["hi"][0]:
        side = np.array(group["side"])
        ok &= side[:, None] != side[None, :]
    return ok


def _prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each unit that have a pair of their own to verify there."""
    out: list[dict] = []
    names = ("unit", "bucket", "side", "lo", "hi", "key", "buckets")
    for tab in sorted_groups(batches, "unit"):
        if tab.num_rows < 2:
            continue
        group = tab.to_pydict()
        minima = np.frombuffer(b"".join(group["sketch"]), "<u4").reshape(-1, SKETCH)
        ok = _may_pair(group, np.array(group["n"]))
        for lo in range(0, len(minima), 64):
            ok[lo : lo + 64] &= (minima[lo : lo + 64, None, :] == minima[None, :, :]).sum(axis=2, dtype=np.int32) >= AGREE
        for i in np.flatnonzero(ok.any(axis=1)):
            out.append({c: group[c][i] for c in names})
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, _PRUNED_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _PRUNED_ARROW)


_PRUNED = "unit long, bucket long, side int, lo int, hi int, key binary, buckets array<long>"
_PRUNED_ARROW = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("side", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.binary()), ("buckets", pa.list_(pa.int64()))])
_MEMBER_ARROW = pa.schema([*_PRUNED_ARROW, ("tokens", pa.binary())])


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Rows as Python values, a few at a time: lists of units or sets in a whole batch may be large."""
    for lo in range(0, batch.num_rows, 32):
        part = batch.slice(lo, 32)
        yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _tokens_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the whole set for each unit in which a document is to be verified."""
    for batch in batches:
        out, size = [], 0
        for key, units, buckets, tokens in _rows(batch, "key", "units", "buckets", "tokens"):
            for u in units:
                out.append(u | {"key": key, "buckets": buckets, "tokens": tokens})
                size += len(tokens) + 8 * len(buckets) + 200
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(out, _MEMBER_ARROW)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _MEMBER_ARROW)


def _roots(links: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            todo = [i]
            root[i] = i
            while todo:
                for j in np.flatnonzero(links[todo.pop()] & (root < 0)):
                    root[j] = i
                    todo.append(j)
    return root


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, roots = [], [], []
    for tab in sorted_groups(batches, "unit"):
        if tab.num_rows < 2:
            continue
        group = tab.to_pydict()
        sets = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
        n = np.array([s.size for s in sets])
        both = common_counts(sets)
        links = _may_pair(group, n) & (both >= SIMILARITY * (n[:, None] + n[None, :] - both) - 1e-6)
        root = _roots(links)
        for i, c in enumerate(links.sum(axis=1)):
            if c:
                keys.append(group["key"][i])
                counts.append(int(c))
                roots.append(group["key"][root[i]])
    yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(roots, pa.binary())], names=["key", "links", "root"])


def _level(classes: DataFrame, level: int, hot: DataFrame | None) -> DataFrame:
    """(key, n, bucket) of one of the first levels, below the buckets of `hot` only."""
    if level == 1:
        return classes.select("key", "n", F.explode("p1").alias("bucket"))
    up, own, at = f"p{level - 1}", f"p{level}", f"a{level}"
    deeper = classes.select("key", "n", up, F.posexplode(F.arrays_zip(own, at)).alias("_i", "_x"))
    deeper = deeper.select("key", "n", F.col(f"_x.{own}").alias("bucket"), F.element_at(up, F.col(f"_x.{at}") + 1).alias("parent"))
    return deeper.join(hot.select(F.col("bucket").alias("parent")).distinct(), "parent", "left_semi").drop("parent").distinct()


def _agreement(large: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, alike): the mean share of minima on which the members of each bucket agree with the one of least key."""
    rows = large.select("key", "bucket").join(classes.select("key", "sketch"), "key")
    first = rows.groupBy("bucket").agg(F.min(F.struct("key", "sketch")).getField("sketch").alias("_first"))
    same = sum((F.substring("sketch", 4 * i + 1, 4) == F.substring("_first", 4 * i + 1, 4)).cast("int") for i in range(SKETCH))
    return rows.join(first, "bucket").groupBy("bucket").agg((F.avg(same) / SKETCH).alias("alike"))


def find_buckets(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], small: int = SMALL) -> tuple[DataFrame, DataFrame | None, int]:
    """(key, bucket, count, tokens) of the members of all buckets to compare, of two classes or more; the
    sets of classes that went deeper than the first levels, if any did; and the deepest level.
    `sets_of` gives (key, n, tokens) of the classes of given keys."""
    found, hot, deep = [], None, None
    level = 1
    while True:
        if level <= LEVELS:
            rows = _level(classes, level, hot)
        else:
            if level == LEVELS + 1:
                deep = sets_of(hot.select("key").distinct())
            paths = hot.groupBy("key").agg(F.collect_list("bucket").alias("hot")).join(deep, "key")
            rows = materialize(paths.mapInArrow(_deeper, "key binary, n int, bucket long").distinct(), f"rows-{level}")
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("n").alias("tokens")).where("count > 1")
        members = materialize(rows.join(sizes, "bucket"), f"paths-{level}")
        is_large = ((F.col("count") > small) | (F.col("tokens") > WEIGHT)) & (F.col("count") > 2)
        large = members.where(is_large)
        if level == DEEPEST or large.isEmpty():
            found.append(members.select("key", "bucket", "count", "tokens"))
            return reduce(DataFrame.unionByName, found), deep, level
        alike = materialize(_agreement(large, classes), f"alike-{level}")
        found.append(members.where(~is_large).select("key", "bucket", "count", "tokens"))
        found.append(large.join(alike.where(F.col("alike") >= ALIKE), "bucket", "left_semi").select("key", "bucket", "count", "tokens"))
        hot = materialize(large.join(alike.where(F.col("alike") < ALIKE), "bucket", "left_semi").select("key", "n", "bucket"), f"hot-{level}")
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, found), deep, level
        level += 1


def deal(members: DataFrame, small: int = SMALL) -> DataFrame:
    """unit, bucket, side, lo, hi, key: buckets that are still large over pairs of blocks."""
    blocks = F.ceil(F.greatest(F.col("count") / (small / 2), F.col("tokens") / (WEIGHT / 2))).cast("int")
    large = (F.col("count") > small) | (F.col("tokens") > WEIGHT)
    rows = members.withColumn("_c", F.when(large, F.least(blocks, F.col("count").cast("int"))).otherwise(1))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("key"), F.col("_c")).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    lo, hi = F.least("side", "_j"), F.greatest("side", "_j")
    unit = F.when(F.col("_c") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", lo, hi))
    return rows.select(unit.alias("unit"), "bucket", "side", lo.alias("lo"), hi.alias("hi"), "key")


def _text_hash() -> Column:
    """Tells texts under one id apart; null and empty are one text."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def _groups(docs: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, text_hash, key and sketches), and a row for each class: key, rep (its row
    with the smallest id, null ids last), root, head (the smallest rep of its group), n_copies, n_links."""
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", _text_hash())
    sketched = materialize(pairs.mapInArrow(_sketch, _SKETCHED), "sketches")
    wide = ("n", "sketch", "p1", "p2", "a2", "p3", "a3")
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # all members of a class have the same values, so any row's will do
    classes = sketched.groupBy("key").agg(F.min(rep).alias("rep"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in wide))
    classes = materialize(classes, "classes")
    live = classes.where("n > 0")

    def sets_of(keys: DataFrame) -> DataFrame:
        """(key, n, tokens) of the classes of given keys: the texts are read again, and only the sets
        that are wanted leave their task."""
        bits = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))
        found = pairs.select("text").mapInArrow(_whole_sets(bits), "key binary, n int, tokens binary")
        found = found.groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        return materialize(found.join(keys.select("key"), "key", "left_semi"), "sets")

    members, deep, depth = find_buckets(live, sets_of, small)
    more = runs_for(levels=depth) - RUNS
    if deep is not None and more > 0:
        again = deep.join(live.select("key", "sketch"), "key").mapInArrow(_more_paths(more), f"key binary, n int, sketch binary, {_PATHS_SQL}")
        members = members.unionByName(find_buckets(materialize(again, "runs"), lambda keys: deep, small)[0])
    members = materialize(deal(members, small), "buckets")
    own = members.select("key", "bucket").distinct().groupBy("key").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    seen = members.join(own, "key").join(live.select("key", "n", "sketch"), "key")
    pruned = seen.repartition("unit").sortWithinPartitions("unit").mapInArrow(_prune, _PRUNED)
    wanted = pruned.groupBy("key").agg(F.collect_list(F.struct("unit", "bucket", "side", "lo", "hi")).alias("units"), F.first("buckets").alias("buckets"))
    wanted = materialize(wanted, "wanted")
    whole = wanted.join(sets_of(wanted).select("key", "tokens"), "key").mapInArrow(_tokens_of, _PRUNED + ", tokens binary")
    found = whole.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify, "key binary, links long, root binary")
    found = materialize(found, "links")

    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    grouped = classes.select("key", "rep", "n_copies").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "key"))
    heads = grouped.groupBy("root").agg(F.min("rep").alias("head"))
    return sketched, grouped.join(heads, "root").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def ngram_jaccard_join(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, class_id (the smallest id of its group of linked classes), copy_id (the smallest id
    with the same set), n_copies (rows with the same set), n_links (classes it is linked to),
    class_key and copy_key (they tell groups and sets apart where the smallest id is null or shared)."""
    sketched, classes = _groups(docs, small)
    table = classes.select("key", F.col("rep.doc_id").alias("copy_id"), F.col("head.doc_id").alias("class_id"), "n_copies", "n_links", F.hex("root").alias("class_key"), F.hex("key").alias("copy_key"))
    return sketched.select("doc_id", "key").join(table, "key").drop("key").select("doc_id", "class_id", "copy_id", "n_copies", "n_links", "class_key", "copy_key")


def keep_one_of_each(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """The rows of `docs`, with all their columns, less all but one of each group: the row with the
    smallest id stays, null ids last (of several rows with that id and the same text, any one)."""
    sketched, classes = _groups(docs, small)
    heads = classes.where("rep = head").select("key", F.col("head.doc_id").alias("_head"), F.col("head.text_hash").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("text_hash") == F.col("_text"))
    heads = sketched.select("key", "doc_id", "text_hash").join(heads, "key").where(same).groupBy("_head", "_text").agg(F.count("*").alias("_rows"))
    # one row per document that stays: as large as the corpus, so it is never broadcast
    heads = materialize(heads, "heads").hint("merge")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), _text_hash().alias("_hash"))
    found = F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_hash") == F.col("_text"))
    if heads.where("_rows > 1").isEmpty():
        return packed.join(heads, found, "left_semi").select("_row.*")
    once = packed.join(heads.where("_rows = 1"), found, "left_semi")
    more = packed.join(heads.where("_rows > 1"), found, "left_semi")
    return once.unionByName(more.dropDuplicates(["_id", "_hash"])).select("_row.*")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))
