"""Personal data, with offset-preserving deobfuscation.

Detection runs twice: on the text itself (the base spans), and on what the transducers make of it.
They map homoglyphs and compatibility forms to ASCII, drop invisible characters, turn spelled digits
into digits and "(at)" / " at ... dot " disguises into "@" and ".". Each keeps which source
characters every output character came from, so a span of the normalised text maps back to the
source. Spans that lie in no base span of their kind are added, so that one may reach over a base span
that shows only part of an address or number; base spans stay.

Edge cases: a null text is empty. Rows are independent: repeated rows, null ids and extra columns
change nothing, and an empty table gives an empty result. Whole texts are scanned in linear time.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "‐": "-", "‑": "-",
    "‒": "-", "–": "-", "−": "-", "。": ".", "ı": "i", "ɑ": "a", "ɡ": "g", "՚": "'", "օ": "o", "ո": "n", "һ": "h",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits in a row that count as a number by themselves; fewer count where they adjoin digits or "+".
LEAST_SPELLED = 7

_ODD = re.compile("[­ıɑɡͰ-ϿЀ-ԯԱ-֏٠-٩۰-۹०-९ -⁯⁰-₟℀-⅏−①-⓿。︀-﹯﻿＀-￯\U0001d400-\U0001d7ff]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_NUMBER = re.compile(rf"(?<!\w)(plus[\s,.-]{{1,3}})?((?:{_WORD})(?:[\s,.-]{{1,3}}(?:{_WORD}|[0-9]))*)(?!\w)", re.I)
#: What may part a shorter spelled run from digits or a plus that it continues.
_ADJOINS = re.compile(r"(?:[ ()]{0,2}|[.-])[0-9]")
_JOINTS = (" ", "(", ")")
_ONE = re.compile(rf"{_WORD}|[0-9]", re.I)
_BRACKET_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|arroba|@)\s{0,3}[\])}>]\s{0,3}", re.I)
_BRACKET_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|point|punto|\.)\s{0,3}[\])}>]\s{0,3}", re.I)
_SPACED = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9])", re.I)
_SPACED_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])", re.I)
_SPACED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]{1,63})+", re.I)
#: Top-level domains are letters, or encoded ones: "priced at 19.99" and "look at v2.x" hold no address.
_LITERAL_TOP = re.compile(r"\.(?:[A-Za-z]{2,63}|xn--[A-Za-z0-9-]+)-*\Z", re.I)
_cache: dict[str, str] = {}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the leftmost non-overlapping matches of each kind that hold."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _DIGIT_RUN.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def plain(c: str) -> str:
    """The ASCII character that one character stands for; itself if none."""
    if c not in _cache:
        to = HOMOGLYPHS.get(c)
        if to is None:
            form = unicodedata.normalize("NFKC", c)
            to = form if len(form) == 1 and form.isascii() else c
            if to == c and unicodedata.decimal(c, None) is not None:
                to = str(unicodedata.decimal(c))
        _cache[c] = to
    return _cache[c]


class Normalised:
    """A text rewritten by edits (start, end, replacement), able to map its spans back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        parts, self.at, self.src, self.whole = [], [], [], []
        done = pos = 0
        for start, end, to in edits:
            for a, b, t, whole in ((done, start, text[done:start], False), (start, end, to, True)):
                if t:
                    parts.append(t)
                    self.at.append(pos)
                    self.src.append((a, b))
                    self.whole.append(whole)
                    pos += len(t)
            done = end
        if done < len(text):
            parts.append(text[done:])
            self.at.append(pos)
            self.src.append((done, len(text)))
            self.whole.append(False)
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of [start, end); an edit counts whole."""
        i = bisect.bisect_right(self.at, start) - 1
        j = bisect.bisect_right(self.at, end - 1) - 1
        a = self.src[i][0] if self.whole[i] else self.src[i][0] + start - self.at[i]
        b = self.src[j][1] if self.whole[j] else self.src[j][0] + end - self.at[j]
        return a, b


def adjoins(text: str, start: int, end: int) -> bool:
    """Whether digits or a plus stand right before the span, or digits right after it."""
    i = start
    while i > 0 and start - i < 2 and text[i - 1] in _JOINTS:
        i -= 1
    if i == start and i > 0 and text[i - 1] in ".-":
        i -= 1
    return (i > 0 and text[i - 1] in "+0123456789") or _ADJOINS.match(text, end) is not None


def edits(text: str) -> list[tuple[int, int, str]]:
    """The transducers' rewrites of a text without homoglyphs, in order, not overlapping."""
    out = []
    low = text.lower()
    if any(c in text for c in INVISIBLE):
        out += [(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]", text)]
    if "(" in text or "[" in text or "{" in text or "<" in text:
        if "at" in low or "arroba" in low or "@" in text:
            out += [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)]
        out += [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)]
    if "at" in low:
        for first in _SPACED.finditer(text):
            m = _SPACED_DOMAIN.match(text, first.end())
            dots = list(_SPACED_DOT.finditer(text, first.end(), m.end()))
            if dots or _LITERAL_TOP.search(m[0]):
                out.append((first.start(), first.end(), "@"))
                out += [(d.start(), d.end(), ".") for d in dots]
    if out and "dot" in low:
        out += [(d.start(), d.end(), ".") for d in _SPACED_DOT.finditer(text)]
    for m in _NUMBER.finditer(text) if any(w in low for w in SPELLED) else ():
        digits = [(x.start(), x.end(), SPELLED.get(x[0].lower(), x[0])) for x in _ONE.finditer(text, m.start(2), m.end(2))]
        if len(digits) < LEAST_SPELLED and not adjoins(text, m.start(), m.end()):
            continue
        begin = m.start()
        for k, (_, b, d) in enumerate(digits):
            out.append((begin, b, ("+" + d) if k == 0 and m[1] else d))
            begin = b
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, done = [], 0
    for e in out:
        if e[0] >= done:
            kept.append(e)
            done = e[1]
    return kept


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the normalised text shows, in source offsets: none within a base span of its kind."""
    straight = text
    if not text.isascii() and _ODD.search(text):
        straight = text.translate({ord(c): plain(c) for c in set(_ODD.findall(text)) if c not in INVISIBLE})
    rewrites = edits(straight)
    if not rewrites and straight is text:
        return []
    norm = Normalised(straight, rewrites)
    taken = [sorted((a, b) for k, a, b in base if k == kind) for kind in range(len(KINDS))]
    out = []
    for kind, start, end in detect(norm.text):
        a, b = norm.back(start, end)
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        i = bisect.bisect_right(taken[kind], (a, len(text)))  # spans of one kind don't overlap
        if not i or taken[kind][i - 1][1] < b:
            out.append((kind, a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (array<struct<kind, start, end>>, by kind as listed, then start) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            column = batch.column("text")
            for i in range(len(batch)):
                text = column[i].as_py() or ""
                own = detect(text)
                base.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(own)])
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(own + added(text, own))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(spans, span)], names=["doc_id", "base", "spans"])

    kinds = "array<struct<kind:string,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {kinds}, spans {kinds}")


def redacted(text: str, mask: str = "*") -> str:
    """The text with every found character masked (same length)."""
    own = detect(text)
    out = list(text)
    for _, a, b in own + added(text, own):
        out[a:b] = mask * (b - a)
    return "".join(out)
