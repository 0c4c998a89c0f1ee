"""Secrets: values in credential contexts, weighed by how many guesses they would take.

Base spans (assignments to credential names, access-key ids, long hexadecimal runs) are found
by exact, linear-time patterns over the whole text and always stay. The value of each
assignment, and of further credential contexts (`CONTEXT`: passphrases, bearer tokens, private keys
and the like), is segmented at minimum cost by dynamic programming into common words (any
case, reversed, or with look-alike digits), dates, repeats, sequences, keyboard walks, and
brute-force spans. A segment costs the logarithm of its guesses plus that of the number of
kinds of segment, since a guesser has to pick one each time; costs add up, so one pass over the
value gives the exact minimum over all its segmentations, whatever its length and however many
segments it takes. A value of a further context whose cost reaches `STRONG` is reported as a
span of kind `context`.

What a segment can be is part of the model: words are those of `WORDS`, a repeated unit has up to
`UNIT` characters (and may be repeated any number of times; its own cost is found by the same
rule), a walk has up to `WALK` keys. Between a context word and its value there is a colon, an
equals sign or one blank; after a blank, where prose may follow, a value that is written like a
word (letters of one case, or with a capital first) doesn't count.

Defined results: null texts count as empty; without spans the digest is that of the empty
string, and max_log10_guesses is null without a credential value. Repeated rows give equal
results; other columns are ignored; an empty table gives no rows. Offsets are code points,
ends exclusive; an assignment's span is the whole match.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("assign", "access", "hex", "context")
STRONG = 10.0
UNIT = 64
WALK = 48
#: Words, dates, repeats, sequences, walks and brute force.
KIND = math.log10(6)
Span = tuple[int, int, str]

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?i:passphrase|passcode|\bpwd|\bpass|credentials?|private_?key|access_?key|bearer)["']?(\x20*[:=]\x20*|\x20)["']?([^\s"'<>,;]{8,})""", re.ASCII)
_PROSE = re.compile(r"[^\W\d_]?(?:[^\W\d_A-Z]+|[A-Z]+)[.!?:)]*|[^\W\d_]+(?:['-][^\W\d_A-Z]+)+[.!?:)]*")
_HINTS = ("passw", "secret", "token", "api")
_MORE_HINTS = ("passphrase", "passcode", "pwd", "pass", "credential", "private", "access", "bearer")

# Common words and passwords, the most usual first.
WORDS = """password admin welcome letmein monkey dragon master login hello secret token pass user root test guest love
shadow sunshine princess football baseball superman batman trustno iloveyou michael jordan jennifer thomas robert daniel
hunter ranger buster soccer hockey killer george andrew charlie summer winter spring autumn london paris berlin madrid
orange banana apple cherry computer internet server database system service default public private key access change
example sample demo temp begin start stop open close red green blue black white silver gold star moon sun sky fire water
earth wind magic happy lucky flower freedom whatever nothing maggie ginger pepper cookie cheese chocolate coffee""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKE = str.maketrans("430157@$!", "aeoistasi")
YEARS = (1900, 2050)
_DATE = re.compile(r"(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2}))", re.ASCII)
_YEAR = re.compile(r"19\d\d|20[0-4]\d", re.ASCII)


@lru_cache(maxsize=1)
def _ranks() -> dict[str, int]:
    return {w: i + 1 for i, w in enumerate(WORDS)}


@lru_cache(maxsize=1)
def _lengths() -> list[int]:
    return sorted({len(w) for w in WORDS})


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, str]:
    """Keys next to each key: in its row, and above and below in rows shifted by half a key each."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near = {row[x] for x in (c - 1, c + 1) if 0 <= x < len(row)}
            for other, shift in ((r - 1, 1 if r > 1 else 1), (r + 1, -1)):
                if 0 <= other < len(ROWS):
                    near |= {ROWS[other][x] for x in (c, c + shift) if 0 <= x < len(ROWS[other])}
            out[key] = near
    return {k: "".join(sorted(v)) for k, v in out.items()}


def _word_cost(s: str) -> float | None:
    """log10 guesses of a common word in some disguise."""
    low = s.lower()
    ranks = _ranks()
    best = None
    for plain, extra in ((low, 1), (low[::-1], 2), (low.translate(LOOKALIKE), 4)):
        if plain in ranks:
            upper = sum(c.isupper() for c in s)
            cases = 1 if not upper else 2 if upper == len(s) or (upper == 1 and s[0].isupper()) else 2 ** min(upper, len(s) - upper) * 2
            cost = math.log10(ranks[plain] * extra * cases)
            best = cost if best is None else min(best, cost)
    return best


def _date_cost(s: str) -> float | None:
    if _YEAR.fullmatch(s):
        return math.log10(max(20, abs(int(s) - 2000)))
    m = _DATE.fullmatch(s)
    if not m or len(s) < 6:
        return None
    if m[1]:
        year, gap, a, b = int(m[1]), m[2], int(m[3]), int(m[4])
    else:
        year, gap, a, b = int(m[8]), m[6], int(m[5]), int(m[7])
        year += 0 if len(m[8]) == 4 else 2000 if year < 50 else 1900
    if not (YEARS[0] <= year <= YEARS[1] and ((1 <= a <= 12 and 1 <= b <= 31) or (1 <= b <= 12 and 1 <= a <= 31))):
        return None
    return math.log10(365 * max(20, abs(year - 2000)) * (4 if gap else 1))


def _walk_cost(length: int, turns: int) -> float:
    """A start key, a direction for each straight stretch, and where the stretches end."""
    keys, degree = sum(map(len, ROWS)), 4.6
    ways = math.lgamma(length) - math.lgamma(turns) - math.lgamma(length - turns + 1)
    return math.log10(keys) + turns * math.log10(degree) + ways / math.log(10)


def _spans_from(s: str, i: int) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of the words, dates, sequences and walks that start at i."""
    n = len(s)
    for length in _lengths():
        if i + length > n:
            break
        cost = _word_cost(s[i : i + length])
        if cost is not None:
            yield i + length, cost
    if s[i].isdigit():
        for j in range(i + 4, min(n, i + 10) + 1):
            if s[j - 1].isdigit():
                cost = _date_cost(s[i:j])
                if cost is not None:
                    yield j, cost
    if i + 1 < n and s[i].isascii() and s[i].isalnum():  # a sequence
        step = ord(s[i + 1]) - ord(s[i])
        if step in (1, -1):
            j = i + 2
            while j < n and s[j].isascii() and s[j].isalnum() and ord(s[j]) - ord(s[j - 1]) == step:
                j += 1
                if j - i >= 3:
                    start = 4 if s[i] in "aAzZ019" else 10 if s[i].isdigit() else 26
                    yield j, math.log10(start * (j - i) * (1 if step > 0 else 2))
    near, low = _neighbours(), s[i : i + WALK].lower()
    turns, last = 0, None
    for k in range(1, len(low)):
        if low[k] not in near.get(low[k - 1], ""):
            break
        way = (near[low[k - 1]].index(low[k]), low[k - 1] < low[k])
        turns += way != last
        last = way
        if k >= 2:
            yield i + k + 1, _walk_cost(k + 1, turns)


@dataclass
class _Run:
    """A maximal stretch of one period: units begin at `first` .. `first + len(fresh) - 1` and end at `end` at the latest. `fresh`
    is False where the unit is itself a repeat (its own unit stands there more often). Of each residue of the
    period, `starts` keeps the segments that may still be the cheapest: (begin, cost without the count)."""

    first: int
    end: int
    unit: int
    fresh: np.ndarray
    starts: dict[int, list[tuple[int, float]]] = field(default_factory=dict)
    costs: dict[int, float] = field(default_factory=dict)

    def cheapest(self, at: int) -> float:
        """The cost of the best segment of this run that ends at `at`."""
        out = math.inf
        for begin, cost in self.starts.get((at - self.first) % self.unit, ()):
            times = (at - begin) // self.unit
            if times >= 2:
                out = min(out, cost + math.log10(times))
        return out

    def begin(self, value: str, at: int, best: float) -> None:
        """A segment may begin at `at`, unless an earlier one of the same unit is at least as cheap at every end: for m more
        units and J >= 2 its count costs log(J + m) - log(J) more, (m + 2) / 2 at most."""
        k = at - self.first
        if k >= self.fresh.size or not self.fresh[k]:
            return
        residue = k % self.unit
        if residue not in self.costs:
            self.costs[residue] = KIND + _unit_cost(value[at : at + self.unit])
        cost, known = best + self.costs[residue], self.starts.setdefault(residue, [])
        if not any(cost >= c + math.log10(((at - b) // self.unit + 2) / 2) for b, c in known):
            known.append((at, cost))


def _runs(s: str) -> list[_Run]:
    """All maximal runs of units of up to `UNIT` characters that stand twice in a row at least, by their beginning."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    left = np.full(codes.size, codes.size + 1)  # the shortest unit found at each place, and how far it reaches
    reach = np.zeros(codes.size, np.int64)
    for unit in range(1, min(UNIT, codes.size // 2) + 1):
        differs = np.flatnonzero(codes[:-unit] != codes[unit:])
        begin = np.concatenate([[0], differs + 1])
        end = np.concatenate([differs, [codes.size - unit]])
        for a, b in zip(begin[end - begin >= unit].tolist(), end[end - begin >= unit].tolist(), strict=True):
            at = np.arange(a, b - unit + 1)
            fresh = (unit % left[at] != 0) | (reach[at] < at + unit)
            mine = fresh & (left[at] > codes.size)
            left[at[mine]], reach[at[mine]] = unit, b + unit
            if unit == 1:
                left[a:b], reach[a:b] = 1, b + 1
            if fresh.any():
                out.append(_Run(a, b + unit, unit, fresh))
    return sorted(out, key=lambda r: r.first)


def log10_guesses(value: str) -> float:
    """The least cost over all segmentations: the segments' log10 guesses, and `KIND` for each."""
    n = len(value)
    # by end: the last segment is a pattern, or a brute-force span that may go on
    done, free = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    done[0] = 0.0
    coming, active = _runs(value)[::-1], []
    for i in range(n + 1):
        while coming and coming[-1].first <= i:
            active.append(coming.pop())
        if active:
            active = [r for r in active if i <= r.end]
            done[i] = min([done[i], *(r.cheapest(i) for r in active)])
        if i == n:
            break
        best = min(done[i], free[i])
        free[i + 1] = min(free[i] + 1.0, done[i] + 1.0 + KIND)
        for j, cost in _spans_from(value, i):
            if best + cost + KIND < done[j]:
                done[j] = best + cost + KIND
        for r in active:
            r.begin(value, i, best)
    return float(min(done[n], free[n]))


@lru_cache(maxsize=4096)
def _unit_cost(unit: str) -> float:
    return log10_guesses(unit)


def base_matches(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans by start, then kind as listed, and the values of the assignments."""
    out: list[Span] = []
    values = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                out.append((m.start(), m.end(), "assign"))
                values.append(m.span(1))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))), values


def find_secrets(text: str) -> tuple[list[Span], list[Span], float | None]:
    """(base spans, all spans, the largest log10 of guesses of a credential value)."""
    base, values = base_matches(text)
    costs = [log10_guesses(text[a:b]) for a, b in values]
    more: list[Span] = []
    low = text.lower()
    if any(h in low for h in _MORE_HINTS):
        taken = 0
        for m in CONTEXT.finditer(text):
            a, b = m.span(2)
            if m[1] == " " and _PROSE.fullmatch(m[2]):
                continue
            while taken < len(base) and base[taken][1] <= a:
                taken += 1
            if taken < len(base) and base[taken][0] < b:
                continue  # a base span already covers it
            cost = log10_guesses(text[a:b])
            if cost >= STRONG:
                more.append((a, b, "context"))
                costs.append(cost)
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]))), max(costs, default=None)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans of every row as arrays of (start, end, kind), and max_log10_guesses."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            found = [find_secrets(t or "") for t in batch.column("text").to_pylist()]
            cols = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[k]] for f in found], kind) for k in (0, 1)]
            yield pa.record_batch([batch.column("doc_id"), *cols, pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "base", "spans", "guesses"])

    spans = "array<struct<start:int,end:int,kind:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {spans}, spans {spans}, guesses double")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))

    def digest(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"), F.col("guesses").alias("max_log10_guesses"))
