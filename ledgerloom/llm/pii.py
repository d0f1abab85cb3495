"""Personal data: base detectors, and detection behind an offset-preserving deobfuscation (operator 10)."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sliced, spread

KINDS = ("email", "ip", "card", "phone")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does, which the look behind says, so that long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LONG_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    """EMAIL's matches; only around an at sign is the pattern tried, as a match has one."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind, leftmost and apart from each other; a failing match is dropped and not tried again."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if _LONG_CARD.search(text):
        out["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    return out


# Characters that look like ASCII ones, spelled digits, and ways to write @ and a dot.
HOMOGLYPHS = dict(zip("аВсСеЕНіІјЈкКМоОрРѕЅТхХуУАυΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "aBcCeEHiIjJkKMoOpPsSTxXyYAuABEZHIKMNOPTYXov", strict=True))
DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT = ("at", "arobase", "arroba", "ät")
DOT = ("dot", "punkt", "point", "punto")
TLD = "com org net edu gov info biz io co eu de fr es it nl at ch uk us ca au".split()

_SPELLED = {w: str(i) for line in DIGITS.values() for i, w in enumerate(line.split())}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


#: Symbols in brackets stand for themselves anywhere; bare words only in an address that has an at and a dot and ends in a known domain.
_BRACKET_AT = re.compile(rf"[ ]?{_OPEN}[ ]?(?:@|{_any(AT)})[ ]?{_SHUT}[ ]?", re.I)
_BRACKET_DOT = re.compile(rf"[ ]?{_OPEN}[ ]?(?:\.|{_any(DOT)})[ ]?{_SHUT}[ ]?", re.I)
_BARE_TAIL = rf"( ?@ ?| {_any(AT)} )[A-Za-z0-9-]+(?:(?: {_any(DOT)} |\.)[A-Za-z0-9-]+)*(?: {_any(DOT)} |\.){_any(TLD)}(?![A-Za-z0-9-])"
_BARE_AT = re.compile(rf" ?@ ?| (?={_any(AT)} )", re.I)
_BARE_REST = re.compile(_BARE_TAIL, re.I)
_BARE_DOT = re.compile(rf" {_any(DOT)} ", re.I)
_BARE_BEFORE = re.compile(rf" {_any(DOT)} $", re.I)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: At least three spelled digits in a row, or among digits.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{_WORD}|[0-9]++)[ -]){{2,}}(?:{_WORD}|[0-9]++)(?!\w)", re.I)
_SPELLED_ONE = re.compile(rf"({_WORD})(?:[ -](?=(?:{_WORD}|[0-9])))?|([0-9]+)[ -](?={_WORD})", re.I)
#: What a text must have for a rule to fit: cheaper to look for, and never missing where the rule fits.
_HINT_BRACKET = re.compile(_OPEN)
_HINT_BARE = re.compile(_BARE_TAIL, re.I)
_HINT_DIGIT = re.compile(rf"(?<!\w)(?:{_WORD})[ -](?:{_WORD}|[0-9])", re.I)
_HINT_LAST_DIGIT = re.compile(rf"[0-9][ -](?:{_WORD})(?!\w)", re.I)
_LOOKALIKE = re.compile("[" + "".join(HOMOGLYPHS) + "！-～​‌‍⁠­﻿٠-٩۰-۹]")
_GONE = "​‌‍⁠­﻿"


def _plain(c: str) -> str:
    if c in _GONE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if "٠" <= c <= "٩" or "۰" <= c <= "۹":
        return str(ord(c) & 15)
    return HOMOGLYPHS[c]


class Mapped:
    """A text with the place in its source of every piece that a transducer copied or rewrote."""

    def __init__(self, text: str):
        self.text, self.starts, self.pieces = text, [0], [(0, len(text), True)]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Applies edits (start, end, new), in order and apart from each other, each as one piece."""
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return self
        out, parts, at, n = Mapped(""), [], 0, 0
        out.starts, out.pieces = [], []

        def put(text, pieces):
            nonlocal n
            parts.append(text)
            for size, src in pieces:
                out.starts.append(n)
                out.pieces.append(src)
                n += size

        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            if at < s:
                put(self.text[at:s], self._copied(at, s))
            if new or s < e:
                put(new, [(len(new), (*self.source(s, e), False))])
            at = e
        out.text = "".join(parts)
        return out

    def _copied(self, s: int, e: int):
        """The source pieces of an unedited stretch, cut to it."""
        k = bisect_right(self.starts, s) - 1
        while s < e:
            to = min(e, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
            if to > s:
                a, b, same = self.pieces[k]
                yield to - s, (a + s - self.starts[k], a + to - self.starts[k], True) if same else (a, b, False)
                s = to
            k += 1

    def source(self, s: int, e: int) -> tuple[int, int]:
        """The source span of the characters from s to e; a rewritten piece counts whole."""
        if s == e:
            k = max(0, bisect_right(self.starts, s) - 1)
            a, b, same = self.pieces[k] if self.pieces else (0, 0, False)
            at = a + s - self.starts[k] if same and self.pieces else b
            return at, at
        i, j = bisect_right(self.starts, s) - 1, bisect_right(self.starts, e - 1) - 1
        (a, _, same_a), (c, d, same_d) = self.pieces[i], self.pieces[j]
        return (a + s - self.starts[i] if same_a else a), (c + e - self.starts[j] if same_d else d)


def _bare(text: str):
    """(start, match of the at sign and what follows) of addresses in bare words; tried at each at only, so long texts are read once."""
    end = 0
    for at in _BARE_AT.finditer(text):
        rest = _BARE_REST.match(text, at.start()) if at.start() >= end else None
        if rest is None:
            continue
        start = at.start()
        while True:
            to = start
            while start > end and text[start - 1] in _NAME:
                start -= 1
            dot = _BARE_BEFORE.search(text, max(end, start - 8), start) if start < to and "." not in text[start:to] else None
            if dot is None or dot.start() <= end or text[dot.start() - 1] not in _NAME:
                break
            start = dot.start()
        if start < at.start():
            yield start, rest
            end = rest.end()


def normalise(text: str) -> Mapped:
    """Composes the transducers: lookalikes, then at and dot disguises, then spelled digits."""
    m = Mapped(text)
    if not text.isascii():
        m = m.rewrite([(x.start(), x.end(), _plain(x[0])) for x in _LOOKALIKE.finditer(m.text)])
    if _HINT_BRACKET.search(m.text):
        m = m.rewrite([(x.start(), x.end(), "@") for x in _BRACKET_AT.finditer(m.text)])
        m = m.rewrite([(x.start(), x.end(), ".") for x in _BRACKET_DOT.finditer(m.text)])
    if _HINT_BARE.search(m.text):
        edits = []
        for start, rest in _bare(m.text):
            dots = [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(m.text, start, rest.end())]
            if "@" not in rest[1] or dots:
                edits += sorted([*dots, (*rest.span(1), "@")])
        m = m.rewrite(edits)
    if _HINT_DIGIT.search(m.text) or _HINT_LAST_DIGIT.search(m.text):
        edits = []
        for x in _SPELLED_RUN.finditer(m.text):
            for d in _SPELLED_ONE.finditer(x[0]):
                edits.append((x.start() + d.start(), x.start() + d.end(), _SPELLED[d[1].lower()] if d[1] else d[2]))
        m = m.rewrite(edits)
    return m


def spans(text: str) -> tuple[dict, dict]:
    """Base spans, and all spans: the base ones and those that only the normalised text shows, apart from the base ones of their kind."""
    base = base_spans(text)
    m = normalise(text)
    if m.text == text:
        return base, base
    every = {}
    for kind, found in base_spans(m.text).items():
        own, extra = base[kind], []
        for s, e in found:
            s, e = m.source(s, e)
            k = bisect_right(own, (s, e))
            if not (k and own[k - 1][1] > s) and not (k < len(own) and own[k][0] < e):
                extra.append((s, e))
        every[kind] = sorted({*own, *extra})
    return base, every


def joined(found: dict) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in found[k])


def redact(text: str | None, every: dict | None = None) -> str | None:
    """The text with each span replaced by <KIND>; of spans that overlap the one that starts first, then the longest, is named."""
    if not text:
        return text
    marks = sorted((s, -e, k) for k, v in (every or spans(text)[1]).items() for s, e in v)
    out, at = [], 0
    for s, e, k in marks:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, -e)
    return "".join([*out, text[at:]]) if marks else text


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, every): two strings kind:start:end,... for each row, in code points with the end exclusive.

    A null text counts as empty; repeated rows and null ids stay as they are,
    an empty table gives no rows, other columns are not looked at, and time
    grows with a text's length, not faster.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans(t) if t else (None, None) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([joined(x[i]) if x[i] else "" for x in found], pa.string()) for i in (0, 1))], ["doc_id", "base", "every"])

        return f

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, f"doc_id {dict(docs.dtypes)[id_col]}, base string, every string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by the name of its kind; all columns stay, whatever their names.

    A null text stays null and an empty one empty, repeated rows stay repeated,
    an empty table gives no rows, and a very long text takes time in proportion
    to its length.
    """
    at = docs.columns.index(text_col)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = pa.array([redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            return batch.set_column(at, batch.schema.field(at), column)

        return f

    return spread(docs).mapInArrow(lambda batches, make=make: (f(b) for f in [make()] for b in sliced(batches)), docs.schema)


def length(docs: DataFrame, text_col: str = "text"):
    """Code points of the text, null for a null text."""
    return F.length(docs[text_col]).cast("long")


def query(docs: DataFrame) -> DataFrame:
    found = detect(docs)
    n = [F.expr(f"cast(size(filter(split(base, ','), x -> startswith(x, '{k}:'))) as bigint) as n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2("base", 256).alias("base_sha256"), F.col("every").alias("spans"))
