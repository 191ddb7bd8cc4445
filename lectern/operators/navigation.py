"""Printed cross-references: finding them with their places, resolving them, and the precision gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_key, printed_number

# An identifier, the words before one by kind, and what separates a list.
IDENTIFIER = r"\d+(?:[.\-–—]\d+)*(?:[A-Za-z])?"
PREFIXES = {
    "figure": r"fig(?:ure|ura)?s?\.?",
    "table": r"tabl(?:e|a)s?",
    "section": r"(?:sections?|secci[oó]n(?:es)?)",
    "chapter": r"(?:chapters?|cap[ií]tulos?)",
    "page": r"(?:pp?\.|p[aá]gs?\.|p[aá]ginas?|pages?)",
}
SEPARATOR = r"\s*(?:,\s*(?:(?:and|y|e)\s+)?|(?:and|y|e)\s+)"
FLOOR = 0.9


def _mentions(text: Column, kind: str) -> Column:
    """array<struct<start, end, kind, identifier>> of one kind, by place.

    A mention is a word of the kind, an identifier, and the identifiers that a list goes on
    with. split() and regexp_extract_all() find the same mentions, so that lengths give
    places; within a mention the identifiers lie side by side, each with what separates it.
    """
    whole = rf"(?iU)\b{PREFIXES[kind]}\s*{IDENTIFIER}\b(?:{SEPARATOR}{IDENTIFIER}\b)*+"
    gaps, found = F.split(text, whole, -1), F.regexp_extract_all(text, F.lit(f"({whole})"), F.lit(1))
    before = lambda parts, i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
    identifier = lambda part: F.regexp_extract(part, rf"(?iU)({IDENTIFIER})$", 1)

    def listed(mention: Column, i: Column) -> Column:
        start = before(gaps, i + 1) + before(found, i)
        rest = F.regexp_replace(mention, rf"(?iU)^{PREFIXES[kind]}\s*", "")
        parts = F.regexp_extract_all(rest, F.lit(rf"(?iU)(\G(?:{SEPARATOR})?{IDENTIFIER}\b)"), F.lit(1))
        first = F.length(mention) - F.length(rest)

        def one(part: Column, k: Column) -> Column:
            end = start + first + before(parts, k + 1)
            name = identifier(part)
            own = F.regexp_extract(name, "^([^-–—]*)", 1) if kind == "page" else name  # of a range of pages the first
            return F.struct(
                F.when(k == 0, start).otherwise(end - F.length(name)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"),
                F.when(k == 0, own).otherwise(name).alias("identifier"),
            )

        return F.transform(parts, one)

    return F.flatten(F.transform(found, listed))


def find_references(passages: DataFrame) -> DataFrame:
    """passages (..., text) -> one row for each mention: the passage's columns but text, start, end, kind, identifier.

    Places are code points; NULs are taken out before they are counted. Null and empty texts
    have no mentions. Mentions of a passage go by place.
    """
    rest = [c for c in passages.columns if c != "text"]
    hint = r"(?iU)\b(?:" + "|".join(PREFIXES.values()) + r")\s*\d"
    said = passages.withColumn("text", F.replace(F.col("text"), F.char(F.lit(0)), F.lit(""))).where(F.col("text").rlike(hint))
    spans = F.array_sort(F.concat(*[_mentions(F.col("text"), kind) for kind in PREFIXES]))
    return said.select(*rest, F.explode(spans).alias("r")).select(*rest, "r.*")


def targets(figures: DataFrame, captions: DataFrame, headings: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, kind, key, page, figure_id) that mentions can point at.

    figures (book_id, identifier, page, figure_id); captions of tables (book_id, identifier,
    page); headings (book_id, title, depth, page); pages (book_id, printed, page).
    """
    none = F.lit(None).cast("string").alias("figure_id")
    word = F.regexp_extract("title", rf"(?iU)^\s*(?:(chapter|cap[ií]tulo)\s+)?({IDENTIFIER})", 1)
    number = F.regexp_extract("title", rf"(?iU)^\s*(?:(chapter|cap[ií]tulo)\s+)?({IDENTIFIER})", 2)
    kind = F.when((word != "") | ((F.col("depth") == 1) & ~number.contains(".")), F.lit("chapter")).otherwise(F.lit("section"))
    return (
        figures.select("book_id", F.lit("figure").alias("kind"), identifier_key(F.col("identifier")).alias("key"), "page", "figure_id")
        .unionByName(captions.select("book_id", F.lit("table").alias("kind"), identifier_key(F.col("identifier")).alias("key"), "page", none))
        .unionByName(headings.where(number != "").select("book_id", kind.alias("kind"), identifier_key(number).alias("key"), "page", none))
        .unionByName(pages.where(printed_number(F.col("printed")).isNotNull()).select("book_id", F.lit("page").alias("kind"), identifier_key(F.col("printed")).alias("key"), "page", none))
    )


def resolve(references: DataFrame, known: DataFrame) -> DataFrame:
    """references with target_page and figure_id where exactly one target has the key; null where none or several do."""
    unique = known.distinct().groupBy("book_id", "kind", "key").agg(F.count("*").alias("n"), F.min("page").alias("target_page"), F.min("figure_id").alias("figure_id")).where("n = 1").drop("n")
    return references.withColumn("key", identifier_key(F.col("identifier"))).join(unique, ["book_id", "kind", "key"], "left").drop("key")


def reference_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("kind").agg(F.count("target_page").alias("resolved"), F.count_if(F.col("target_page").isNull()).alias("unresolved"))


def precision_gate(links: DataFrame, checks: DataFrame, floor: float = FLOOR) -> DataFrame:
    """links without those of kinds whose checked share (kind, correct) is under the floor; unchecked kinds stay."""
    bad = checks.groupBy("kind").agg(F.avg(F.col("correct").cast("int")).alias("precision")).where(F.col("precision") < floor)
    return links.join(bad.select("kind"), "kind", "left_anti")


def numbered_parents(headings: DataFrame) -> DataFrame:
    """headings (book_id, number, page) -> with parent: the longest number that stands before a dot in it and is there."""
    firsts = headings.groupBy("book_id", "number").agg(F.min("page").alias("page"))
    parts = F.split("number", r"\.")
    above = firsts.select("book_id", "number", "page", F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "."))).alias("parent"))
    there = firsts.select("book_id", F.col("number").alias("parent"), F.lit(True).alias("there"))
    met = above.join(there, ["book_id", "parent"], "left").withColumn("ok", F.col("there") & (F.col("parent") != F.col("number")))
    return met.groupBy("book_id", "number", "page").agg(F.max_by(F.when(F.col("ok"), F.col("parent")), F.when(F.col("ok"), F.length("parent"))).alias("parent"))


def content_pages(passages: DataFrame) -> DataFrame:
    """passages (book_id, kind, pdf_start, pdf_end) -> (book_id, page): pages that content covers, each once."""
    return passages.where("kind = 'content'").select("book_id", F.explode(F.sequence("pdf_start", "pdf_end")).alias("page")).distinct()


def scanned_books(content: DataFrame, pages: DataFrame) -> DataFrame:
    """content (book_id, page), pages (book_id, pdf_page, text_source) -> (book_id, scanned): more than half of its content pages are kept readings."""
    met = content.join(pages.select("book_id", F.col("pdf_page").alias("page"), "text_source"), ["book_id", "page"], "left")
    return met.groupBy("book_id").agg((2 * F.count_if(F.col("text_source") == "ocr") > F.count("*")).alias("scanned"))


def chapter_gaps(headings: DataFrame) -> DataFrame:
    """headings (book_id, number) -> (book_id, number): whole numbers from 1 to the largest that no heading has."""
    whole = headings.where(F.col("number").rlike("^[0-9]{1,4}$")).select("book_id", F.col("number").cast("int").alias("number")).distinct()
    every = whole.groupBy("book_id").agg(F.max("number").alias("last")).select("book_id", F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("number"))
    return every.join(whole, ["book_id", "number"], "left_anti")


def numbered_tree(headings: DataFrame) -> DataFrame:
    """headings (book_id, number, title, page) -> (book_id, number, title, page, parent, depth), each number once.

    Of several headings with a number the first by page and title counts. A section's parent
    is the longest number before a dot of its own that is there; sections without any are
    dropped. depth is the number of ancestors and one.
    """
    first = headings.groupBy("book_id", "number").agg(F.min(F.struct("page", "title")).alias("f")).select("book_id", "number", "f.title", "f.page")
    parents = numbered_parents(first).select("book_id", "number", "parent")
    tree = first.join(parents, ["book_id", "number"]).where(F.col("parent").isNotNull() | ~F.col("number").contains("."))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("number", r"\."))), lambda d: F.array_join(F.slice(F.split("number", r"\."), F.lit(1), d), "."))
    there = first.select("book_id", F.col("number").alias("above"))
    depth = first.select("book_id", "number", F.explode(above).alias("above")).join(there, ["book_id", "above"], "left_semi").groupBy("book_id", "number").agg(F.count("*").cast("int").alias("depth"))
    return tree.join(depth, ["book_id", "number"])


def tree_order(paths: DataFrame) -> DataFrame:
    """paths (book_id, page, path array<string>) -> with ord: by page, depth and path within a book."""
    w = Window.partitionBy("book_id").orderBy("page", F.size("path"), "path")
    return paths.withColumn("ord", F.row_number().over(w))


def level_counts(paths: DataFrame) -> DataFrame:
    """paths (book_id, path) -> (book_id, depth, n): how many entries each level of the contents has."""
    return paths.groupBy("book_id", F.size("path").alias("depth")).agg(F.count("*").alias("n"))
