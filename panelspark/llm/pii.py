"""Personal data in texts, also where it is disguised, with spans in the source text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones, beside them the letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
# Spelled digits of the documents' languages.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for @, for the point and for the plus sign.
AT_WORDS = ("at", "arobase", "arroba")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus", "más")
# Characters without width.
INVISIBLE = "​‌‍⁠﻿­"

#: Full-width forms and digits of other scripts follow a rule: shifted by a constant.
SHIFTED = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {zero + k: str(k) for zero in (0x0660, 0x06F0, 0x0966) for k in range(10)}
ONE_TO_ONE = SHIFTED | {ord(k): v for k, v in HOMOGLYPHS.items()}

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

_digit, _at, _dot, _plus = "|".join(SPELLED), "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(PLUS_WORDS)
#: Rules on the words of a text whose letters are undone. None begins with a run of blanks or gives one back, so each place is read a bounded number of times.
BRACKETED = re.compile(rf"[\[({{<]\s*+(?:(?P<at>{_at}|@)|{_dot}|\.)\s*+[\])}}>]\s*+", re.IGNORECASE)
BARE = re.compile(rf"(?<=[A-Za-z0-9])(?P<at>\s++(?:{_at})\s++)(?P<rest>[A-Za-z0-9-]++(?:\s++(?:{_dot})\s++[A-Za-z0-9-]++)+)(?![A-Za-z0-9-])", re.IGNORECASE)
DOT = re.compile(rf"\s+(?:{_dot})\s+", re.IGNORECASE)
# Words that begin a phrase and no domain, as in "at the dot".
NO_DOMAIN = frozenset("a an the this that these those each every any some no my your his her its our their one".split())
_unit = rf"(?:(?:{_digit})\b|[0-9])"
NUMBER = re.compile(rf"\b(?:(?:{_plus})\s++)?{_unit}(?:[\s,.-]*+{_unit}){{6,}}", re.IGNORECASE)
WORD = re.compile(rf"(?P<plus>(?:{_plus})\s+)|(?P<word>{_digit})\b(?:[\s,-]+(?=(?:{_digit})\b|[0-9]))?", re.IGNORECASE)
HIDDEN = re.compile(f"[{INVISIBLE}]+")
#: Letters that match i and s where case is ignored, but are not lowered to them.
ODD_CASE = str.maketrans("İıſ", "iis")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, in time linear in the text: every match has its own @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and not overlapping; matches that fail their test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def letter_edits(text: str) -> list[tuple[int, int, str]]:
    """What the transducer of letters writes: (start, end, written) for homoglyphs, other digits and hidden characters."""
    if text.isascii():
        return []
    out = [(i, i + 1, ONE_TO_ONE[ord(c)]) for i, c in enumerate(text) if ord(c) in ONE_TO_ONE]
    return sorted(out + [(*m.span(), "") for m in HIDDEN.finditer(text)])


def is_domain(parts: list[str]) -> bool:
    """Whether words between spoken points can be a domain: letters last, and not the beginning of a phrase."""
    return len(parts[-1]) > 1 and parts[-1].isalpha() and parts[0].lower() not in NO_DOMAIN


def word_edits(text: str) -> list[tuple[int, int, str]]:
    """What the transducer of words writes: (start, end, written) without overlaps, in order."""
    out: list[tuple[int, int, str]] = []
    end = 0
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start > end and text[start - 1].isspace():
            start -= 1
        end = m.end()
        out.append((start, end, "@" if m["at"] else "."))
    for m in BARE.finditer(text):
        if is_domain([p for p in DOT.split(m["rest"]) if p]):
            out.append((*m.span("at"), "@"))
            out += [(*d.span(), ".") for d in DOT.finditer(text, m.start("rest"), m.end("rest"))]
    for m in NUMBER.finditer(text):
        for w in WORD.finditer(text, m.start(), m.end()):
            out.append((*w.span(), "+" if w["plus"] else SPELLED[w["word"].translate(ODD_CASE).lower()]))
    kept, end = [], 0
    for e in sorted(out):
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


class Normalised:
    """A text after its edits, and the way back to source offsets."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]) -> None:
        parts, self.starts, self.segments, at, n = [], [], [], 0, 0

        def add(a: int, b: int, written: str, edited: bool) -> None:
            nonlocal n
            if written:
                self.starts.append(n)
                self.segments.append((a, b, edited))
                parts.append(written)
                n += len(written)

        for a, b, written in changes:
            add(at, a, text[at:a], False)
            add(a, b, written, True)
            at = b
        add(at, len(text), text[at:], False)
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a normalised one, and whether an edit lies in it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, _, first = self.segments[i]
        b, stop, last = self.segments[j]
        left = a if first else a + start - self.starts[i]
        right = stop if last else b + end - self.starts[j]
        return left, right, first or last or j > i


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans of a text, and those that only the normalised text shows; kinds as listed, then by start."""
    if not text:
        return [], []
    base = detect(text)
    more: list[tuple[str, int, int]] = []
    letters = letter_edits(text)
    plain = Normalised(text, letters)
    words = word_edits(plain.text)
    if letters or words:
        normal = Normalised(plain.text, words)
        for kind, found in detect(normal.text).items():
            # a span is inside the base span that begins last before it, or in none: base spans do not overlap
            starts = [x for x, _ in base[kind]]
            for a, b in found:
                middle_a, middle_b, by_words = normal.source(a, b)
                left, right, by_letters = plain.source(middle_a, middle_b)
                i = bisect_right(starts, left) - 1
                if (by_words or by_letters) and (i < 0 or right > base[kind][i][1]):
                    more.append((kind, left, right))
    return [(k, a, b) for k in KINDS for a, b in base[k]], more


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of each text: (id, base, added), both arrays of (kind, start, stop) in code points of the source.

    ``base`` are the plain matches. ``added`` are those found after two
    transducers, one on the other's output: letters (homoglyphs, digits of other
    scripts, hidden characters), then words (spelled digits and at/dot in the
    documents' languages); offsets go back through both. None lies wholly in a
    base span of its kind, but one may reach beyond a base span that is only its
    plain part. Where two rules fit at overlapping places, the one that begins
    first is applied, of equal beginnings the shorter. Null and empty texts have
    no spans, an empty table gives an empty one, and very long texts are read
    whole in time linear in their length. Ids may be null or repeated; other
    columns are not carried.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("base", SPAN), T.StructField("added", SPAN)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            found = [spans(t.as_py()) for t in batch.column(1)]
            sides = [pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], names=[f.name for f in schema])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)
