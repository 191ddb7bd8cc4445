"""Text rules as column expressions: sections, numbers, labels, ids, line joins, reading quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section titles by kind, in lower case.
KINDS = {
    "summary": ["summary", "resumen"],
    "glossary": ["glossary", "glosario"],
    "exercise": ["problems", "problemas", "respuestas a problemas", "respuestas a los problemas"],
    "references": ["reference", "references", "bibliografía", "general references", "referencias generales", "selected introductory reading"],
}
# Titles of contents and index sections.
EXCLUDED = ["index", "índice", "content", "contents", "detailed contents", "contenido", "resumen del contenido"]
# Patterns of captions, sentence ends and chapter headings.
FIGURE_ID = r"[A-Za-z]?\d+(?:[.\-–—]\d+)*(?:[A-Za-z])?"
CAPTION = rf"(?iU)^\s*(?:fig(?:ure|ura)?s?\.?|ilustraci[oó]n|abbildung)\s*({FIGURE_ID})\b"
SENTENCE_END = r"[.!?…][\s\"'’”)\]]*$"
FRONT_MATTER = ["preface", "prefacio", "foreword", "prólogo", "prologo", "acknowledgments", "acknowledgements", "agradecimientos"]
LIST_START = r"^(?:\d+[.)]|\d+[–\-]\d+(?=\s+[A-Z])|[A-Za-z][.)]|\([A-Za-z]\))\s+"
TABLE_CAPTION = r"(?imU)^\s*(?:Table|Tabla)\s+(\d+(?:[.\-–—]\d+)*(?:[A-Za-z])?)\b"
CHAPTER = r"(?iU)^(chapter|cap[ií]tulo|kapitel)\s+(\d+)\b"
# The form of a Roman numeral, vowels, punctuation and names of languages.
ROMAN = r"(?i)^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
VOWELS = "aeiouyáéíóúüAEIOUYÁÉÍÓÚÜ"
PUNCTUATION = ".,;:!?()[]{}\"'"
LANGUAGES = {"en": "en", "english": "en", "es": "es", "spanish": "es", "ca": "ca", "catalan": "ca"}


def strip(text: Column | str) -> Column:
    """text without white space of any kind, line ends included, at its ends; F.trim() takes off U+0020 only."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def no_spaces(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def passage_kind(path: Column) -> Column:
    """Kind of the nearest heading that names one; ``content`` without any. White space doesn't count."""
    known = {t.replace(" ", ""): k for k, titles in KINDS.items() for t in titles}
    kinds = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    named = F.filter(F.transform(F.reverse(path), lambda t: F.try_element_at(kinds, no_spaces(t))), lambda k: k.isNotNull())
    return F.coalesce(F.get(named, F.lit(0)), F.lit("content"))


def excluded_section(path: Column) -> Column:
    """Whether any title of the path is one of the contents or index titles; inner white space counts."""
    return F.coalesce(F.exists(path, lambda t: F.lower(strip(t)).isin(EXCLUDED)), F.lit(False))


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral in any case, without a check of its form."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    values = F.transform(F.reverse(F.split(F.upper(text), "")), lambda c: F.coalesce(F.try_element_at(value, c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("largest"))
    return F.aggregate(
        values,
        start,
        lambda s, v: F.struct((s["total"] + F.when(v < s["largest"], -v).otherwise(v)).alias("total"), F.greatest(s["largest"], v).alias("largest")),
        lambda s: s["total"],
    )


def printed_number(text: Column) -> Column:
    """struct(kind, value) of a printed page number: arabic, ``prefix:<letters and sign>`` or roman; null if it is none."""
    own = strip(text)
    number = lambda kind, value: F.struct(kind.alias("kind"), value.cast("int").alias("value"))
    return (
        F.when(own.rlike(r"^[0-9]{1,5}$"), number(F.lit("arabic"), own))
        .when(own.rlike(r"^[A-Za-z]{1,8}[:-][0-9]{1,5}$"), number(F.concat(F.lit("prefix:"), F.regexp_extract(own, r"^([A-Za-z]+[:-])", 1)), F.regexp_extract(own, r"([0-9]+)$", 1)))
        .when((own != "") & own.rlike(ROMAN), number(F.lit("roman"), roman_value(own)))
    )


def roman_numeral(value: Column) -> Column:
    """Upper-case Roman numeral of 1 to 3,999."""

    def digit(power: int, one: str, five: str, ten: str) -> Column:
        d = F.floor(value / power) % 10
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), (d + 1).cast("int"))

    return F.concat(F.repeat(F.lit("M"), F.floor(value / 1000).cast("int")), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))


def format_number(kind: Column, value: Column, example: Column) -> Column:
    """Printed form of a number in the style of ``example``: its case, or its prefix and sign."""
    numeral = roman_numeral(value)
    return (
        F.when(kind == "arabic", value.cast("string"))
        .when(kind == "roman", F.when(example == F.lower(example), F.lower(numeral)).otherwise(numeral))
        .when(kind.startswith("prefix:"), F.concat(F.regexp_replace(kind, "^prefix:", ""), value.cast("string")))
    )


def join_lines(lines: Column) -> Column:
    """Lines as one text: a hyphen before a lower-case start is taken out, else a space stands between."""
    return F.aggregate(
        F.transform(lines, lambda x: strip(x)),
        F.lit(""),
        lambda text, line: F.when(text.rlike("[-\\u00ad]$") & line.rlike(r"(?U)^\p{Ll}"), F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line)).otherwise(
            strip(F.concat(text, F.lit(" "), line))
        ),
    )


def margin_key(text: Column) -> Column:
    """What a repeated margin line has in common: case, white space and digits are evened out."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), r"[0-9]+", "#")


def passage_label(book: Column, start: Column, end: Column, first: Column, last: Column, reason: Column) -> Column:
    """``book: pdf page(s) a[–b] <print page(s): c[–d]>``, or why the print page isn't known."""
    one = start == end
    span = lambda a, b: F.when(one, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))
    pages = F.when(one, F.lit("page")).otherwise(F.lit("pages"))
    printed = F.when(first.isNotNull(), F.concat(F.lit("print "), pages, F.lit(": "), span(first, last))).otherwise(F.concat(F.lit("print page unknown: "), F.coalesce(reason, F.lit(""))))
    return F.concat(book, F.lit(": pdf "), pages, F.lit(" "), span(start, end), F.lit(" <"), printed, F.lit(">"))


def json_string(text: Column) -> Column:
    """text as a JSON string with non-ASCII kept and control characters as lower-case \\u escapes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    for c in map(chr, range(32)):
        out = F.replace(out, F.lit(c), F.lit(named.get(c, f"\\u{ord(c):04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def passage_id(book: Column, start: Column, end: Column, text: Column) -> Column:
    """SHA-256 of ``["book", [start, end], "text"]``; kind, section and metadata never change it."""
    return F.sha2(F.concat(F.lit("["), json_string(book), F.lit(", ["), start.cast("string"), F.lit(", "), end.cast("string"), F.lit("], "), json_string(text), F.lit("]")), 256)


def table_name(version: str, model: Column, roles: bool = False, purpose: str = "embed") -> Column:
    """Name of the table of an index: version, whether roles are on, a stem of the model and a digest of it."""
    stem = F.substring(F.regexp_replace(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 32)
    mark = "r" if roles and purpose not in ("embed-large", "embed-large-bulk") else ""
    return F.concat(F.lit(f"e_{version}{mark}_"), F.when(stem == "", F.lit("model")).otherwise(stem), F.lit("_"), F.substring(F.sha2(model, 256), 1, 16))


def version_at_least(version: Column, n: int) -> Column:
    """Versions are numbers: v10 is later than v6."""
    return F.coalesce(F.substring(version, 2, 9).try_cast("int") >= n, F.lit(False))


def figure_key(identifier: Column) -> Column:
    return F.regexp_replace(F.lower(identifier), "[–—]", "-")


def identifier_key(identifier: Column) -> Column:
    """Like figure_key(), and a dot equals a hyphen: 7.3 and 7-3 are one."""
    return F.regexp_replace(F.lower(identifier), r"[.\-–—]", "-")


def language_code(language: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.lower(F.trim(language)))


def parse_grade(reply: Column) -> Column:
    """yes is true, no is false, all else null."""
    own = F.lower(strip(reply))
    return F.when(own == "yes", F.lit(True)).when(own == "no", F.lit(False))


def reading_lines(text: Column) -> Column:
    """Lines of a reading, at line ends of any kind, without the preview's mark and white space at their ends."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda x: strip(F.replace(x, F.lit("Copyrighted material"), F.lit(""))))


def nonwords(text: Column) -> Column:
    """struct(n, bad): tokens without digits, and those that look like no word (letters, a vowel, two at least)."""
    tokens = F.filter(F.split(text, r"[ \t\n\r\f\u000b ]+"), lambda t: (t != "") & ~t.rlike("[0-9]"))
    bare = F.transform(tokens, lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    letters = lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    good = lambda t: (letters(t) >= 2) & (letters(t) * 10 >= F.length(t) * 7) & t.rlike(f"[{VOWELS}]")
    return F.struct(F.size(bare).alias("n"), F.size(F.filter(bare, lambda t: ~good(t))).alias("bad"))


def failed_rules(text: Column, source: Column, ink: Column, finish: Column, language: Column, detected: Column, candidates: Column, neighbours: Column) -> Column:
    """Reasons why a page's reading doesn't pass, in order; none for a hidden page.

    candidates: array<struct<kind, value>>; neighbours: array<struct<offset, candidates>>.
    """
    ocr = source.isin("ocr", "inherited-ocr")
    quality = nonwords(text)
    share = quality["bad"] / F.greatest(quality["n"], F.lit(1))
    some = F.exists(neighbours, lambda n: F.exists(n["candidates"], lambda c: F.exists(candidates, lambda o: o["kind"] == c["kind"])))
    agree = F.exists(neighbours, lambda n: F.exists(n["candidates"], lambda c: F.exists(candidates, lambda o: (o["kind"] == c["kind"]) & (o["value"] + n["offset"] == c["value"]))))
    shown = ocr & (ink | (strip(text) != ""))
    rules = [
        ("token-limit", (source == "ocr") & (finish == "length")),
        ("page-timeout", (source == "ocr") & (finish == "timeout")),
        ("empty-ink", ink & (F.length(strip(text)) < 40)),
        ("language", ocr & (F.length(text) >= 1000) & ~detected.eqNullSafe(language)),
        ("nonwords", ocr & (quality["n"] >= 50) & (share > 0.5)),
        ("number-missing", shown & (F.size(candidates) == 0)),
        ("number-order", shown & (F.size(candidates) > 0) & some & ~agree),
    ]
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return F.when(source == "hidden", F.array().cast("array<string>")).otherwise(named)


def needs_rotation(rules: Column) -> Column:
    return F.arrays_overlap(rules, F.array(*map(F.lit, ["empty-ink", "nonwords", "page-timeout"])))


def rate_text(hits: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit("0/0")).otherwise(F.concat(hits.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), F.bround(100 * hits / n).cast("int").cast("string"), F.lit("%)")))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.char(F.lit(0)), F.lit(""))


def map_without_nul(values: Column) -> Column:
    """A map of strings without U+0000 in its keys and values; of keys that become equal the last stays."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct(without_nul(e["key"]).alias("key"), without_nul(e["value"]).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def caption_identifier(text: Column) -> Column:
    """Identifier of a caption at the start of a text; null without one."""
    return F.nullif(F.regexp_extract(text, CAPTION, 1), F.lit(""))


def table_identifiers(text: Column) -> Column:
    """Identifiers of the table captions that start lines of a text, in order."""
    return F.regexp_extract_all(text, F.lit(TABLE_CAPTION), F.lit(1))


def kind_label(kind: Column, source: Column) -> Column:
    """What a reader is shown of a passage's kind and of a read text: `` (kind)`` and `` (OCR)``, nothing for content."""
    return F.concat(F.when(kind == "content", "").otherwise(F.concat(F.lit(" ("), kind, F.lit(")"))), F.when(source.isin("ocr", "inherited-ocr"), " (OCR)").otherwise(""))


def clamped_page(page: Column, last: Column) -> Column:
    """A page within 1 and the last."""
    return F.greatest(F.lit(1), F.least(page, last))


def link_segments(text: Column, links: Column) -> Column:
    """text cut at its links (array<struct<start, end, target>>, code points): array<struct<text, target>> whose texts join to it.

    Links go by start and end; one that overlaps an earlier one, is empty or lies outside is plain text.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,target:string>>").alias("out"))
    piece = lambda a, b, target: F.struct(F.substring(text, a + 1, b - a).alias("text"), target.alias("target"))
    none = F.lit(None).cast("string")

    def step(s: Column, x: Column) -> Column:
        fits = (x["start"] >= s["at"]) & (x["end"] > x["start"]) & (x["end"] <= F.length(text))
        plain = F.when(x["start"] > s["at"], F.array(piece(s["at"], x["start"], none))).otherwise(F.array().cast("array<struct<text:string,target:string>>"))
        return F.when(fits, F.struct(x["end"].alias("at"), F.concat(s["out"], plain, F.array(piece(x["start"], x["end"], x["target"]))).alias("out"))).otherwise(s)

    rest = lambda s: F.when(s["at"] < F.length(text), F.concat(s["out"], F.array(piece(s["at"], F.length(text), none)))).otherwise(s["out"])
    return F.aggregate(F.array_sort(links), start, step, rest)
