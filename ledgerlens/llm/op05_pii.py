"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans (e-mail, IP, card, phone) are found by exact, linear-time patterns over the whole text
and always stay. The model segments the tokens of the whole text: each span of up to `MAX_TOKENS`
tokens and `MAX_CHARS` characters is scored as a whole by features of its written form, its arithmetic (check digits,
calendar, octets), its cue words and what it touches, for each type, plus weights for adjacent
types. Dynamic programming over boundaries and types (bounded segment length, so linear in the
tokens) gives the best segmentation; base spans are fixed segments in it. The types are the base
kinds (so spelled-out e-mail addresses, national phone numbers or cards with other separators are
found) and `ssn` (social security numbers), `iban`, `date` (dates of birth) and `name`. What the
model decides is reported; no pattern filters it afterwards.

Only spans with a digit, a spelled-out at-sign or a name's cue may be typed, so text without
such marks nearby is `other` for certain and is passed over; tokens around marks stream through
and finished segments are forgotten, so memory grows neither with the text nor with its digits.

The weights are learned here, by conditional log-likelihood over segmentations of sentences
made from patterns (`training_sentences`, a fixed seed): no row of the corpus is used.

Defined results: null texts count as empty; empty texts have no spans and the digest of the
empty string. Repeated rows give equal results; other columns are ignored; an empty table
gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
MORE = ("ssn", "iban", "date", "name")
TYPES = ("other", *KINDS, *MORE)
MAX_TOKENS = 16
MAX_CHARS = 64
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASCII_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 10 <= len(_ASCII_DIGIT.findall(s)) <= 15


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), "email"))
                end = m.end()
    if _ASCII_DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _ip_ok(m.group())]
        out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if _card_ok(m.group())]
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if _phone_ok(m.group())]
    return sorted(out, key=lambda s: (s[0], TYPES.index(s[2])))


# --- the model ---------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|[^\W]")
#: Words that announce personal data, and titles before names.
CUES = {
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "date": ("born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "naissance", "nacido"),
    "name": ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "contact", "sincerely", "signed"),
    "phone": ("phone", "tel", "telephone", "mobile", "cell", "fax", "call", "telefon", "téléphone", "teléfono"),
    "email": ("mail", "email", "write", "courriel", "correo"),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
_CUE_REACH = 6
_AT = r"[(\[{] ?at ?[)\]}]"
_AT_SIGN = re.compile(_AT, re.IGNORECASE)
_AT_END = re.compile(_AT + r"\Z", re.IGNORECASE)
_MARK = re.compile(r"[0-9]+|[(\[{] ?[aA][tT] ?[)\]}]")
_CUE = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(_CUE_OF, key=len, reverse=True))})(?![^\W\d_])", re.IGNORECASE)
#: No candidate and no cue reaches over more tokens than this, and a token holds no blank.
_REACH = MAX_TOKENS + _CUE_REACH


def marks(text: str) -> list[tuple[int, int]]:
    """Runs of digits, spelled-out at-signs and cues, in order."""
    out = [m.span() for m in _MARK.finditer(text)]
    low = text.lower()
    if len(low) != len(text):
        return sorted(out + [m.span() for m in _CUE.finditer(text)])
    for cue in _CUE_OF:  # plain searches for each cue take a tenth of the time of one pattern of all
        at = low.find(cue)
        while at >= 0:
            end = at + len(cue)
            if not (at and low[at - 1].isalpha()) and not low[end : end + 1].isalpha():
                out.append((at, end))
            at = low.find(cue, end)
    return sorted(out)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every candidate: `_REACH` blank-separated pieces on both sides of each mark,
    joined where they meet. Elsewhere every token is `other`, so the best segmentation of the
    regions is that of the whole text."""
    lo = hi = last = -1
    for start, end in marks(text):
        if lo >= 0:
            if start > hi:
                hi = _right(text, last)
            a = start if start <= hi else _left(text, start)
            if a <= hi:
                last = max(last, end)
                continue
            yield lo, hi
            lo = a
        else:
            lo = _left(text, start)
        hi = last = end
    if lo >= 0:
        yield lo, _right(text, last)


def _left(text: str, at: int) -> int:
    for _ in range(_REACH):
        at = text.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at


def _right(text: str, at: int) -> int:
    for _ in range(_REACH):
        at = text.find(" ", at + 1)
        if at < 0:
            return len(text)
    return at


class _Kinds(dict):
    """Characters by kind: 9, A, a, a blank, or themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "9" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c
        self[code] = kind
        return kind


_KIND_OF = _Kinds()
_RUNS = re.compile(r"(.)\1+")
#: Written forms of whole spans, over kinds of characters.
_FORMS = [
    ("ssn", re.compile(r"999[- ]99[- ]9999")),
    ("iban", re.compile(r"AA99(?: ?[A9]{4}){2,7}(?: ?[A9]{1,4})?")),
    ("date", re.compile(r"9999[-./]99[-./]99|99?[-./]99?[-./](?:99)?99|99?\.? [Aa]a{2,9} 9999|[Aa]a{2,9} 99?, 9999")),
    ("name", re.compile(r"Aa+(?:-Aa+)?(?: (?:A\.|Aa+(?:-Aa+)?)){1,3}")),
    ("phone", re.compile(r"(?:\(9{2,5}\)|9{2,5})[-/. ]{0,2}9{2,4}(?:[-. ]9{2,4}){1,3}|99{9,11}")),
    ("card", re.compile(r"9{14,19}|9{4}([-. ])9{4}(?:\1)9{4}(?:\1)9{2,4}|9{4}[- ]9{6}[- ]9{4,5}")),
    ("ip", re.compile(r"9{1,3}(?:\.9{1,3}){3}")),
    ("email", re.compile(r"[aA9._-]+ ?[(\[{] ?aa ?[)\]}] ?[aA9-]+(?: ?(?:\.|[(\[{] ?aaa ?[)\]}]) ?[aA9-]+)+")),
]


def _checks(s: str, forms: tuple[str, ...]) -> tuple[str, ...]:
    """What arithmetic says of a span of the given forms."""
    out = []
    digits = "".join(c for c in s if c in "0123456789")
    for form in forms:
        if form == "card":
            out.append("luhn" if luhn(digits) else "not-luhn")
        elif form == "iban":
            plain = s.replace(" ", "")
            ok = 15 <= len(plain) <= 34 and plain.isascii() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
            out.append("mod97" if ok else "not-mod97")
        elif form == "ssn":
            out.append("issued" if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else "never-issued")
        elif form == "ip":
            out.append("octets" if all(int(p) <= 255 for p in s.split(".")) else "not-octets")
        elif form == "date":
            parts = [int(p) for p in re.findall("[0-9]+", s)]
            year = max(parts)
            rest = [p for p in parts if p != year]
            ok = (1900 <= year <= 2025 or year < 100) and all(1 <= p <= 31 for p in rest) and (len(rest) < 2 or min(rest) <= 12)
            out.append("calendar" if ok else "not-calendar")
    return tuple(out)


class Weights:
    """Weights of span features by type, and of adjacent types."""

    def __init__(self) -> None:
        self.state: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(TYPES)))
        self.step = np.zeros((len(TYPES), len(TYPES)))
        self.known: dict[tuple, np.ndarray] = {}

    def scores(self, seen: tuple) -> np.ndarray:
        """The score of a span as each type (none as `other`), by what is seen of it."""
        found = self.known.get(seen)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = sum((self.state[f] for f in features(seen) if f in self.state), np.zeros(len(TYPES)))
            found[0] = -np.inf
            self.known[seen] = found
        return found


@lru_cache(maxsize=100_000)
def _written(raw: str) -> tuple[tuple[str, ...], tuple]:
    """The forms of a span by its kinds of characters, and the coarse measures that features use."""
    forms = tuple(k for k, p in _FORMS if p.fullmatch(raw))
    digits, letters, shape = raw.count("9"), raw.count("A") + raw.count("a"), _RUNS.sub(r"\1", raw)
    return forms, (min(5, raw.count(" ") + 1), min(digits, 24) // 2, min(letters, 24) // 4, shape if len(shape) <= 7 else "long")


def seen_of(text: str, a: int, b: int, cue: str) -> tuple | None:
    """All that the features of text[a:b] depend on: measures, cue, what it touches, forms and checks.
    None if it has no known written form and no cue, so nothing speaks for a type."""
    s = text[a:b]
    forms, measures = _written(s.translate(_KIND_OF))
    if "email" in forms and not _AT_SIGN.search(s):
        forms = tuple(f for f in forms if f != "email")
    if not forms and not cue:
        return None
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    touch = (before.isalnum() or before in "-._@/" and before != "", after.isalnum() or after in "-@/" and after != "")
    return measures, cue, touch, forms, _checks(s, forms) if forms else ()


@lru_cache(maxsize=50_000)
def features(seen: tuple) -> tuple[str, ...]:
    (words, digits, letters, shape), cue, touch, forms, checks = seen
    found = ["bias", f"cue={cue}", f"words={words}", f"digits={digits}", f"letters={letters}", f"shape={shape}"]
    if not forms:
        found += ["no-form", f"no-form&cue={cue}"]
    for f in forms:
        found += [f"form={f}", f"form={f}&cue={'own' if cue == f else 'other' if cue else 'none'}"]
        found += [f"form={f}&{c}" for c in checks]
    if touch[0]:
        found.append("joined-before")
    if touch[1]:
        found.append("joined-after")
    return tuple(found)


class _Window:
    """The tokens of a stretch and which spans of them may be typed.

    A typed span starts at a digit, a plus sign, an opening bracket before a digit or a capital (or at any
    letter if it has a spelled-out at-sign), ends at a letter or digit, has no line break and no gap
    of two characters, and has a digit, a spelled-out at-sign or a name's cue before it. It has a known
    written form or follows a cue."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.cues, self.mark, self.gap = text, [], [], [], []
        self._cue, self._where = "", -99

    def add(self, a: int, b: int) -> None:
        w, j = self.text[a:b], len(self.tokens)
        self.cues.append(self._cue if j - self._where <= _CUE_REACH else "")
        self.gap.append(bool(self.tokens) and (a - self.tokens[-1][1] > 1 or "\n" in self.text[self.tokens[-1][1] : a]))
        self.tokens.append((a, b))
        # the last token with a digit, or that ends a spelled-out at-sign
        marked = w[0] in "0123456789" or (w in ")]}" and _AT_END.search(self.text, max(0, b - 6), b) is not None)
        self.mark.append(j if marked else self.mark[-1] if j else -99)
        kind = _CUE_OF.get(w.lower())
        if kind:
            self._cue, self._where = kind, j

    def drop(self, n: int) -> None:
        """Forget the first n tokens."""
        for x in (self.tokens, self.cues, self.mark, self.gap):
            del x[:n]
        self.mark = [m - n for m in self.mark]
        self._where -= n

    def spans_ending_at(self, j: int) -> Iterator[tuple[int, tuple]]:
        """(first token, what is seen) of the spans whose last token is j."""
        text, tokens, mark = self.text, self.tokens, self.mark[j]
        b = tokens[j][1]
        if not text[b - 1].isalnum() or (mark <= j - MAX_TOKENS and "name" not in self.cues[max(0, j - MAX_TOKENS + 1) : j + 1]):
            return
        for i in range(j, max(-1, j - MAX_TOKENS), -1):
            a, cue = tokens[i][0], self.cues[i]
            if b - a > MAX_CHARS:
                return
            c = text[a]
            if c.isdigit() or c == "+" or c.isupper() or (c == "(" and text[a + 1 : a + 2].isdigit()):
                may = mark >= i or (cue == "name" and c.isupper())
            else:
                may = mark >= i and c.isalpha() and _AT_SIGN.search(text, a, b) is not None
            seen = seen_of(text, a, b, cue) if may else None
            if seen is not None:
                yield i, seen
            if self.gap[i]:
                return


def decode(text: str, lo: int, hi: int, w: Weights, fixed: list[Span], block: int = 512) -> Iterator[Span]:
    """The typed segments of the best segmentation of text[lo:hi], as (start, end, type).

    `fixed` are base spans in order: each is a segment of its kind, and no other may touch its tokens.
    Tokens stream through; once more than `block` are held, the segments that all open paths
    share are given out and forgotten, so memory does not grow with the stretch.
    """
    win, step = _Window(text), w.step
    start = np.full(len(TYPES), -np.inf)
    start[0] = 0.0
    best, back = [start], [(np.zeros(len(TYPES), np.int64), np.zeros(len(TYPES), np.int64))]
    into: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[bool] = []  # tokens of fixed spans
    shut, one, none = np.full(len(TYPES), -np.inf), np.ones(len(TYPES), np.int64), np.zeros(len(TYPES), np.int64)
    at, limit, plain = 0, block, True

    def path(j: int, k: int) -> list[Span]:
        out = []
        while j > 0:
            length, last = int(back[j][0][k]), int(back[j][1][k])
            if k:
                out.append((win.tokens[j - length][0], win.tokens[j - 1][1], TYPES[k]))
            j, k = j - length, last
        return out[::-1]

    for m in _TOKEN.finditer(text, lo, hi):
        a, b = m.span()
        j = len(win.tokens)
        win.add(a, b)
        while at < len(fixed) and fixed[at][1] <= a:
            at += 1
        inside = at < len(fixed) and fixed[at][0] < b
        held.append(inside)
        if plain:  # only `other` is open here
            into.append((best[j][0] + step[0], none))
        else:
            arrive = best[j][:, None] + step
            into.append((arrive.max(axis=0), arrive.argmax(axis=0)))
        now, length, last = shut.copy(), one.copy(), none.copy()
        plain = not inside
        if inside:
            if fixed[at][1] <= b or _TOKEN.search(text, b, min(hi, fixed[at][1])) is None:  # its last token
                i = j
                while i > 0 and held[i - 1] and win.tokens[i - 1][1] > fixed[at][0]:
                    i -= 1
                k = TYPES.index(fixed[at][2])
                now[k], length[k], last[k] = into[i][0][k], j + 1 - i, into[i][1][k]
                taken_to = b
                at += 1
                while at < len(fixed) and fixed[at][0] < taken_to:  # base spans of different kinds may overlap; the first holds its tokens
                    at += 1
        else:
            now[0], last[0] = into[j][0][0], into[j][1][0]
            for i, seen in win.spans_ending_at(j):
                if held[i]:
                    break
                score = into[i][0] + w.scores(seen)
                better = score > now
                if better.any():
                    plain = False
                    now[better], length[better], last[better] = score[better], j + 1 - i, into[i][1][better]
        best.append(now)
        back.append((length, last))
        if j + 1 >= limit and np.isfinite(now).any():
            open_ = {(x, int(k)) for x in range(max(0, j + 2 - MAX_TOKENS), j + 2) for k in np.flatnonzero(np.isfinite(best[x]))}
            while len(open_) > 1:
                x, k = max(open_)
                open_.remove((x, k))
                open_.add((x - int(back[x][0][k]), int(back[x][1][k])))
            x, k = open_.pop()
            yield from path(x, k)
            kept = np.full(len(TYPES), -np.inf)
            kept[k] = best[x][k]
            arrive = kept[:, None] + step
            into = [(arrive.max(axis=0), arrive.argmax(axis=0)), *into[x + 1 :]] if x < len(into) else []
            best = [kept, *best[x + 1 :]]
            back, held = back[x:], held[x:]
            win.drop(x)
            limit = len(win.tokens) + block
    n = len(win.tokens)
    final = best[n] + (step[:, 0] if _TOKEN.search(text, hi) else 0.0)
    if np.isfinite(final).any():
        yield from path(n, int(final.argmax()))


def training_sentences(seed: int = 5, n: int = 260) -> list[tuple[str, list[Span]]]:
    """Sentences made from patterns, with the spans of their personal data, and look-alikes without."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = rng.choice

    def word(k: int = 3) -> str:
        return "".join(pick("bcdfghjklmnprstvwz") + pick("aeiouéä") for _ in range(rng.randrange(1, k))) + pick(("", "n", "r", "s"))

    def capital() -> str:
        return (word(3) + pick("aeilmnorst")).capitalize()

    def iban() -> str:
        country, body = pick(("DE", "FR", "GB", "ES", "NL", "IT")), pick(("", "ABCD", "WXYZ")) + digits(pick((14, 16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        plain = f"{country}{check:02d}{body}"
        return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if rng.random() < 0.5 else plain

    def card(valid: bool) -> str:
        body = pick("3456") + digits(pick((13, 14, 14, 14, 15)))
        plain = next(body + d for d in "0123456789" if luhn(body + d) == valid)
        gap = pick(("", " ", "-", "."))
        return gap.join(plain[i : i + 4] for i in range(0, len(plain), 4))

    def date(valid: bool) -> str:
        y, m, d = rng.randrange(1925, 2010), rng.randrange(1, 13), rng.randrange(13, 29)
        if not valid:
            m, d = rng.randrange(32, 99), rng.randrange(32, 99)
        return pick((f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{d:02d}/{m:02d}/{y}", f"{d} {capital()} {y}" if valid else f"{d}.{m}.{y}"))

    def phone() -> str:
        return pick((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)}/{digits(4)}-{digits(3)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"0{digits(10)}"))

    def ssn(valid: bool) -> str:
        return f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}" if valid else pick((f"000-{digits(2)}-{digits(4)}", f"9{digits(2)}-{digits(2)}-{digits(4)}"))

    def name() -> str:
        return pick((f"{capital()} {capital()}", f"{capital()} {capital()}", f"{capital()} {pick('ABCDEFGHKLM')}. {capital()}", f"{capital()}-{capital()} {capital()}"))

    def mail() -> str:
        local, host = pick((word(4), f"{word(3)}.{word(3)}", f"{word(3)}{digits(2)}")), pick((word(4), f"{word(3)}-{word(2)}"))
        return pick((f"{local} [at] {host} [dot] com", f"{local} (at) {host}.org", f"{local}[at]{host}.net", f"{local} (at) {host} (dot) com")).replace("é", "e").replace("ä", "a")

    made = {
        "email": lambda: (pick(("mail ", "email ", "write to ", "")), mail()),
        "ip": lambda: (pick(("", "host ", "from ")), ".".join(str(rng.randrange(1, 255)) for _ in range(4))),
        "card": lambda: (pick(("", "card ", "paid with ")), card(True)),
        "phone": lambda: (pick(("phone ", "tel: ", "call ", "mobile ", "fax ", "Telefon ", "call me at ")), phone()),
        "ssn": lambda: (pick(("SSN ", "ssn: ", "social security number ", "SSN is ", "")), ssn(True)),
        "iban": lambda: (pick(("IBAN ", "account ", "Konto ", "IBAN: ", "")), iban()),
        "date": lambda: (pick(("born ", "born on ", "dob: ", "date of birth ", "geboren am ", "birthday ")), date(True)),
        "name": lambda: (pick(("Mr ", "Mrs. ", "Dr. ", "contact ", "Herr ", "Frau ", "Madame ", "sincerely, ", "signed ")), name()),
    }
    plain = [
        lambda: digits(rng.randrange(1, 9)), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}-{digits(2)}", lambda: date(rng.random() < 0.7), lambda: "on " + date(True),
        lambda: card(False), lambda: digits(16) + "7", lambda: f"{capital()} {digits(2)}", lambda: f"{capital()} {capital()}", lambda: f"{rng.randrange(300, 900)}.{rng.randrange(300, 900)}.1.1",
        lambda: f"${digits(2)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"order {digits(3)}-{digits(3)}-{digits(4)}-{digits(2)}", lambda: f"part no {capital()[:2].upper()}{digits(6)}",
        lambda: ssn(False), lambda: f"call of the {capital()}", lambda: f"contact {word()} {word()}", lambda: f"(see {digits(2)}) at {word()}", lambda: f"{digits(4)} {digits(4)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
        lambda: f"version {digits(2)}.{digits(2)}.{digits(4)}.{digits(1)}", lambda: f"the account of {word()} {digits(2)}", lambda: f"Table {digits(1)} {digits(3)} {digits(3)} {digits(3)}",
    ]
    out = []
    for k in range(n):
        text, spans = "", []
        for kind in rng.sample([*rng.sample(list(made), 2), *[""] * (1 + k % 3)], 3 + k % 3):
            text += " ".join(word() for _ in range(rng.randrange(1, 4))) + pick((" ", ", ", ": ", " ", "\n", ". "))
            cue, value = made[kind]() if kind else ("", pick(plain)())
            text += cue
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + pick((" ", " ", ". ", ", ", "\n", "; "))
        out.append((text + word() + pick((".", "")), spans))
    return out


def _candidates(text: str) -> tuple[_Window, list[tuple[int, int, tuple]]]:
    """All tokens of a text, and (first token, last token + 1, what is seen) of every span that may be typed."""
    win, out = _Window(text), []
    for j, m in enumerate(_TOKEN.finditer(text)):
        win.add(*m.span())
        out += [(i, j + 1, seen) for i, seen in win.spans_ending_at(j)]
    return win, out


@lru_cache(maxsize=1)
def trained(rounds: int = 5, rate: float = 0.3, decay: float = 1e-3) -> Weights:
    """Stochastic gradient ascent of the conditional log-likelihood of the training segmentations."""
    w, data = Weights(), []
    for text, spans in training_sentences():
        win, candidates = _candidates(text)
        first, end = {a: i for i, (a, _) in enumerate(win.tokens)}, {b: i + 1 for i, (_, b) in enumerate(win.tokens)}
        gold = {(first[a], end[b]): TYPES.index(k) for a, b, k in spans}
        data.append((len(win.tokens), [(i, j, features(seen)) for i, j, seen in candidates], gold))
    for r in range(rounds):
        for n, candidates, gold in data:
            _ascend(w, n, candidates, gold, rate / (1 + 0.3 * r), decay)
    w.state = dict(w.state)
    return w


def _ascend(w: Weights, n: int, candidates: list, gold: dict[tuple[int, int], int], rate: float, decay: float) -> None:
    """One step: observed minus expected features, by forward-backward over segments."""
    size = len(TYPES)
    alpha, beta = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf)
    alpha[0, 0], beta[n] = 0.0, 0.0
    scores = [sum((w.state[f] for f in fs), np.zeros(size)) for _, _, fs in candidates]
    for x in scores:
        x[0] = -np.inf
    by_end: dict[int, list[int]] = defaultdict(list)
    by_start: dict[int, list[int]] = defaultdict(list)
    for c, (i, j, _) in enumerate(candidates):
        by_end[j].append(c)
        by_start[i].append(c)
    into = np.full((n + 1, size), -np.inf)
    for j in range(n + 1):
        if j:
            alpha[j, 0] = into[j - 1, 0]
            for c in by_end[j]:
                alpha[j] = np.logaddexp(alpha[j], into[candidates[c][0]] + scores[c])
        into[j] = np.logaddexp.reduce(alpha[j][:, None] + w.step, axis=0)
    for i in range(n - 1, -1, -1):
        ahead = np.full(size, -np.inf)
        ahead[0] = beta[i + 1, 0]
        for c in by_start[i]:
            ahead = np.logaddexp(ahead, scores[c] + beta[candidates[c][1]])
        beta[i] = np.logaddexp.reduce(w.step + ahead, axis=1)
    total = np.logaddexp.reduce(alpha[n])
    change = np.zeros_like(w.step)
    push: dict[str, np.ndarray] = {}
    for c, (i, j, fs) in enumerate(candidates):
        flow = np.exp(alpha[i][:, None] + w.step + (scores[c] + beta[j]) - total)
        change -= flow
        p = -flow.sum(axis=0)
        k = gold.get((i, j))
        if k is not None:
            p[k] += 1
        if np.abs(p).max() > 1e-6:
            for f in fs:
                push[f] = push[f] + p if f in push else p
    for i in range(n):
        change[:, 0] -= np.exp(alpha[i] + w.step[:, 0] + beta[i + 1, 0] - total)
    ends = {i: (j, k) for (i, j), k in gold.items()}
    at = last = 0
    while at < n:
        at, k = ends.get(at, (at + 1, 0))
        change[last, k] += 1
        last = k
    for f, p in push.items():
        w.state[f] = w.state[f] + rate * (p - decay * w.state[f])
    w.step += rate * (change - decay * w.step)


def find_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start, then kind."""
    base = base_spans(text)
    more: list[Span] = []
    at = 0
    for lo, hi in regions(text):
        while at < len(base) and base[at][1] <= lo:
            at += 1
        more += decode(text, lo, hi, w, list(takewhile(lambda s, hi=hi: s[0] < hi, islice(base, at, None))))
    return base, sorted({*base, *more}, key=lambda s: (s[0], TYPES.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, and the base and all spans of every row as arrays of (start, end, kind)."""
    w = trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            found = [find_spans(t or "", w) for t in batch.column("text").to_pylist()]
            cols = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[k]] for f in found], kind) for k in (0, 1)]
            yield pa.record_batch([batch.column("doc_id"), *cols], names=["doc_id", "base", "spans"])

    spans = "array<struct<start:int,end:int,kind:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(documents(spark, sf_dir))

    def digest(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"))
