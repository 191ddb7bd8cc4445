"""Personal data: offset-preserving deobfuscation, detection, and spans mapped back to the source.

The deobfuscation is a cascade of three transducers (look-alikes, spelled digits, at and dot).
Each reads its tokens with a compiled automaton and writes what they stand for, and a tape
keeps the source characters of every character written.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Same matches as the contract's pattern, found from each @ so that a long run of letters costs its length once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _part(x: str) -> bool:
    return len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255


def _luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[::2] + [2 * d - 9 * (d > 4) for d in own[1::2]]) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold; failing ones are dropped without another try."""
    found = list(emails(text))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters of other scripts that look like Latin ones.
_CYRILLIC = dict(zip("аеорсхуіјѕԁһԛԝАВЕКМНОРСТХУІЈЅ", "aeopcxyijsdhqwABEKMHOPCTXYIJS"))
_GREEK = dict(zip("οινυκρταΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oivukptaABEZHIKMNOPTYX"))
_FULL = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_OTHER = {"。": ".", "｡": ".", "․": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
_UNSEEN = dict.fromkeys("­​‌‍⁠﻿", "")
LOOKALIKES = _CYRILLIC | _GREEK | _FULL | _OTHER | _UNSEEN | {chr(c): str(int(chr(c))) for z in (0x660, 0x6F0, 0x966) for c in range(z, z + 10)}
_LOOKALIKE = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")

# Spelled digits.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_DIGIT = "|".join(sorted(DIGITS, key=len, reverse=True))
#: A run of spelled digits and figures; it is undone if it has a spelled one and as many digits as the shortest identifier.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ ,.-]*+)?+(?:{_DIGIT}|[0-9]++)(?:[ ().,-]++(?:{_DIGIT}|[0-9]++))++(?!\w)", re.I)
LEAST_DIGITS = 4
_DIGIT_WORD = re.compile(rf"(?<!\w)(?:{_DIGIT})(?!\w)|(?<!\w)plus[ ,.-]*", re.I)
_COMMAS = re.compile(r",")

_B = r"[\[({<]"
_E = r"[\])}>]"
_AT = rf"\s*{_B}\s*(?:at|@|arroba|chez)\s*{_E}\s*|\s+at\s+|\s+AT\s+"
_DOT = rf"\s*{_B}\s*(?:dot|punto|punkt|point|\.)\s*{_E}\s*|\s+dot\s+|\s+DOT\s+"
_NAME = r"[A-Za-z0-9_%+-]++"
#: A chain of names and dots, as long as it goes, and what makes an address of it: an at and a domain.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:\.|{_DOT}){_NAME})*+(?:(?P<at>@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++)?", re.I
)
_DOT_MARK = re.compile(rf"(?:{_DOT})", re.I)
_HINT = re.compile(r"[\[({<]\s*(?:at|@|arroba|chez|dot|punto|punkt|point|\.)\s*[\])}>]|\sdot\s", re.I)
_DIGIT_HINT = re.compile(rf"(?<!\w)(?:{_DIGIT})[ ,.-]+(?:{_DIGIT}|[0-9]+)(?!\w)", re.I)


class Tape:
    """A text under rewriting; of every character it knows the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace [from, to) by a string, for sorted changes that don't overlap. Each character is copied once."""
        if not changes:
            return
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            texts += [self.text[at:a], new]
            for own, first in ((starts, self.start), (ends, self.end)):
                own.extend(first[at:a])
            starts.extend([self.start[a]] * len(new))
            ends.extend([self.end[b - 1]] * len(new))
            at = b
        self.text = "".join([*texts, self.text[at:]])
        starts.extend(self.start[at:])
        ends.extend(self.end[at:])
        self.start, self.end = starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


class Transducer:
    """An automaton for tokens, and what it writes for each: changes [from, to) -> string, in order, of one match."""

    def __init__(self, tokens: re.Pattern, write: Callable[[re.Match], list[tuple[int, int, str]]]):
        self.tokens, self.write = tokens, write

    def run(self, tape: Tape) -> None:
        tape.rewrite([change for m in self.tokens.finditer(tape.text) for change in self.write(m)])


def _lookalike(m: re.Match) -> list[tuple[int, int, str]]:
    return [(*m.span(), LOOKALIKES[m[0]])]


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    own = list(_DIGIT_WORD.finditer(m.string, *m.span()))
    words = [w for w in own if w[0].lower() in DIGITS]
    if not words or len(words) + sum(map(str.isdecimal, m[0])) < LEAST_DIGITS:
        return []
    changes = [(w.start(), w.end(), DIGITS.get(w[0].lower(), "+")) for w in own]
    changes += [(c.start(), c.end(), "") for c in _COMMAS.finditer(m.string, *m.span())]
    return sorted(changes)


def _at_and_dot(m: re.Match) -> list[tuple[int, int, str]]:
    if not m["at"]:
        return []
    bare = not re.search(r"[@\[({<]", m[0])
    if bare and not _DOT_MARK.search(m[0], m.end("at") - m.start()):  # "look at example.com" is no address
        return []
    at = m.start("at"), m.end("at")
    changes = [(*at, "@")] if m["at"] != "@" else []
    for area in ((m.start(), at[0]), (at[1], m.end())):
        changes += [(d.start(), d.end(), ".") for d in _DOT_MARK.finditer(m.string, *area)]
    return sorted(changes)


CASCADE = [Transducer(_LOOKALIKE, _lookalike), Transducer(_SPELLED, _spelled), Transducer(_DISGUISED, _at_and_dot)]


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows, in places of the source.

    None overlaps a base span, unless it holds one of its kind and reaches beyond it.
    """
    if not (_LOOKALIKE.search(text) or _HINT.search(text) or _DIGIT_HINT.search(text)):
        return []
    tape = Tape(text)
    for step in CASCADE:
        step.run(tape)
    if tape.text == text:
        return []
    taken, starts, found = bytearray(len(text)), [x for _, x, _ in base], []
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for kind, a, b in base_spans(tape.text):
        a, b = tape.source(a, b)
        inside = range(bisect.bisect_left(starts, a), bisect.bisect_left(starts, b))
        if taken.find(1, a, b) < 0 or any(base[i][0] == kind and base[i][2] <= b and base[i][1:] != (a, b) for i in inside):
            found.append((kind, a, b))
            taken[a:b] = b"\1" * (b - a)
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, base, added), one row for each row of docs.

    Both are arrays of struct(kind, start, end) in code points of the source, end exclusive,
    by start and then kind. ``base`` is found in the text as it stands, ``added`` after
    look-alike letters, spelled digits and at/dot disguises are undone. A null text is
    empty; texts of any length are read whole; repeated rows have their spans each; other
    columns are not read; an empty table gives no rows. A bare "at" before a domain with a
    plain dot ("look at example.com") is taken for a word.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(found: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                own = base_spans(text)
                base.append(rows(own))
                added.append(rows(added_spans(text, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(added, spans)], names=["id", "base", "added"])

    shape = "array<struct<kind:string,start:bigint,end:bigint>>"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(texts, run, f"id {kind}, base {shape}, added {shape}").withColumnRenamed("id", id_col)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of each row of documents; a null text has none."""
    found = find_pii(table(spark, sf_dir, "documents"))
    write = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    rank = lambda k: F.when(k == "email", 0).when(k == "ip", 1).when(k == "card", 2).otherwise(3)
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(write("base"), 256).alias("base_sha256"),
        write(every).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )
