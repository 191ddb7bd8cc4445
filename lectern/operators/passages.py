"""Passages: printed page numbers, cross-page joins, breadcrumbs, figure ids, margins and fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, excluded_section, format_number, margin_key

CANDIDATES = "array<struct<kind:string,value:int,text:string>>"


def printed_pages(pages: DataFrame) -> DataFrame:
    """pages (book_id, pdf_page, candidates) -> with printed, method (read, inferred, none) and reason.

    A candidate is supported if a page one or two away has the number that the distance
    asks for (two away only if the page between has no candidates). Exactly one supported
    candidate is read. A page without candidates between two accepted ones that differ by 2
    is inferred; inferred pages support nothing.
    """
    w = Window.partitionBy("book_id").orderBy("pdf_page")
    own = F.coalesce("candidates", F.array().cast(CANDIDATES))
    at = pages.withColumn("candidates", own)
    for name, step in (("b1", F.lag("candidates", 1)), ("b2", F.lag("candidates", 2)), ("a1", F.lead("candidates", 1)), ("a2", F.lead("candidates", 2))):
        at = at.withColumn(name, F.coalesce(step.over(w), F.array().cast(CANDIDATES)))

    def there(side: str, c: Column, offset: int) -> Column:
        return F.exists(side, lambda o: (o["kind"] == c["kind"]) & (o["value"] == c["value"] + offset))

    def backed(c: Column) -> Column:
        near = there("b1", c, -1) | there("a1", c, 1)
        return near | (there("b2", c, -2) & (F.size("b1") == 0)) | (there("a2", c, 2) & (F.size("a1") == 0))

    supported = F.filter("candidates", backed)
    read = at.withColumn("good", supported).withColumn("got", F.when(F.size("good") == 1, F.get("good", F.lit(0))))
    before, after = F.lag("got").over(w), F.lead("got").over(w)
    gap = (F.size("candidates") == 0) & (before["kind"] == after["kind"]) & (after["value"] - before["value"] == 2)
    full = read.withColumns({"gap": F.coalesce(gap, F.lit(False)), "middle": format_number(before["kind"], before["value"] + 1, before["text"])})
    reason = (
        F.when(F.col("got").isNotNull() | F.col("gap"), F.lit(None).cast("string"))
        .when(F.size("good") > 1, F.lit("ambiguous-header-number"))
        .when(F.size("candidates") > 0, F.lit("out-of-sequence"))
        .otherwise(F.lit("no-header-number"))
    )
    return full.select(
        *pages.columns,
        F.when(F.col("got").isNotNull(), F.col("got.text")).when(F.col("gap"), F.col("middle")).alias("printed"),
        F.when(F.col("got").isNotNull(), F.lit("read")).when(F.col("gap"), F.lit("inferred")).otherwise(F.lit("none")).alias("method"),
        reason.alias("reason"),
    )


def join_across_pages(passages: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """passages (book_id, ord, pdf_start, pdf_end, section_path, kind, text, ocr, check_page) -> joined where a sentence runs on.

    A passage goes on the one before if it starts on a later page with no hidden page
    (book_id, pdf_page) between, both are content of one section and neither is doubtful,
    the first has no sentence end, and the second starts in lower case or the first ends in
    a letter and a hyphen. Runs are islands of rows, each folded in order; ord is renumbered.
    """
    w = Window.partitionBy("book_id").orderBy("ord")
    sure = (F.col("kind") == "content") & ~F.col("ocr") & ~F.col("check_page")
    own = passages.withColumn("sure", sure)
    if hidden is not None:
        marks = own.select("book_id", "ord", "pdf_start", F.lag("pdf_end").over(w).alias("prev_end"))
        # Hidden pages before each place, counted along the book: more at the start than at the end before it means one between.
        bound = marks.where("prev_end + 1 < pdf_start").select("book_id", "ord", F.explode(F.array(F.struct(F.col("prev_end").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("pdf_start") - 1).alias("at"), F.lit(1).alias("sign")))).alias("b"))
        both = bound.select("book_id", "ord", "b.at", "b.sign", F.lit(0).alias("one")).unionByName(hidden.select("book_id", F.lit(None).cast("int").alias("ord"), F.col("pdf_page").alias("at"), F.lit(0).alias("sign"), F.lit(1).alias("one")).distinct())
        seen = F.sum("one").over(Window.partitionBy("book_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        between = both.withColumn("seen", seen).where("sign != 0").groupBy("book_id", "ord").agg(F.sum(F.col("seen") * F.col("sign")).alias("n")).where("n > 0").select("book_id", "ord")
        own = own.join(between.withColumn("blocked", F.lit(True)), ["book_id", "ord"], "left")
    else:
        own = own.withColumn("blocked", F.lit(None).cast("boolean"))
    prev = lambda c: F.lag(c).over(w)
    hyphen = prev("text").rlike("[\\p{L}][-\\u00ad]$")
    goes_on = (
        (prev("pdf_end") < F.col("pdf_start"))
        & F.col("blocked").isNull()
        & prev("section_path").eqNullSafe(F.col("section_path"))
        & F.col("sure")
        & prev("sure")
        & ~prev("text").rlike(SENTENCE_END)
        & (F.col("text").rlike(r"^\p{Ll}") | hyphen)
    )
    islands = own.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    part = F.struct("ord", "text", "pdf_start", "pdf_end")
    runs = islands.groupBy("book_id", "island").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.min_by("section_path", "ord").alias("section_path"), F.min_by("kind", "ord").alias("kind"))

    def join(text: Column, more: Column) -> Column:
        cut = text.rlike("[\\p{L}][-\\u00ad]$")
        return F.when(cut, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), more)).otherwise(F.trim(F.concat(text, F.lit(" "), more)))

    rest = F.slice("parts", F.lit(2), F.size("parts"))
    text = F.aggregate(rest, F.get("parts", F.lit(0))["text"], lambda t, p: join(t, p["text"]))
    return runs.select(
        "book_id",
        F.col("island").cast("int").alias("ord"),
        F.get("parts", F.lit(0))["pdf_start"].alias("pdf_start"),
        F.element_at("parts", -1)["pdf_end"].alias("pdf_end"),
        "section_path",
        "kind",
        text.alias("text"),
        F.size("parts").alias("n_parts"),
    )


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """pages (book_id, pdf_page, path) -> the last path seen, carried over pages without one; excluded paths show as empty but are carried.

    A path is an array of titles, or a string that is one title.
    """
    w = Window.partitionBy("book_id").orderBy("pdf_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = pages.withColumn("path", F.last("path", ignorenulls=True).over(w))
    listed = pages.schema["path"].dataType.typeName() == "array"
    titles, none = (F.col("path"), F.slice("path", 1, 0)) if listed else (F.array("path"), F.lit(""))
    return carried.withColumn("path", F.when(excluded_section(titles), none).otherwise(F.col("path")))


def path_prefixes(paths: DataFrame) -> DataFrame:
    """paths (book_id, path, page) -> every prefix at its least page: (book_id, prefix, depth, page)."""
    each = paths.select("book_id", "page", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.slice("path", F.lit(1), d))).alias("prefix"))
    return each.groupBy("book_id", "prefix").agg(F.min("page").alias("page")).select("book_id", "prefix", F.size("prefix").alias("depth"), "page")


def figure_ids(captions: DataFrame) -> DataFrame:
    """captions (book_id, pdf_page, identifier, text, ord) -> with occurrence (nth of equal captions) and an id that holds it."""
    same = Window.partitionBy("book_id", "pdf_page", "identifier", "text").orderBy("ord")
    numbered = captions.withColumn("occurrence", F.row_number().over(same))
    return numbered.withColumn("id", F.sha2(F.to_json(F.array("book_id", F.col("pdf_page").cast("string"), "identifier", "text", F.col("occurrence").cast("string"))), 256))


def repeated_margins(lines: DataFrame, pages: int = 2) -> DataFrame:
    """lines (book_id, pdf_page, text) -> (book_id, key, n_pages) of lines that come on so many pages, digits evened out."""
    keyed = lines.select("book_id", "pdf_page", margin_key(F.col("text")).alias("key"))
    return keyed.groupBy("book_id", "key").agg(F.count_distinct("pdf_page").alias("n_pages")).where(F.col("n_pages") >= pages)


def dominant_size(blocks: DataFrame) -> DataFrame:
    """blocks (book_id, size, chars, pos) -> the font size with most characters of each book; the first seen of equals."""
    sums = blocks.groupBy("book_id", "size").agg(F.sum("chars").alias("chars"), F.min("pos").alias("pos"))
    return sums.groupBy("book_id").agg(F.max_by("size", F.struct("chars", -F.col("pos"))).alias("body_size"))


def line_gap(lines: DataFrame) -> DataFrame:
    """lines (page, y0, y1) -> the median gap between a line and the next of each page."""
    w = Window.partitionBy("page").orderBy("y0", "y1")
    return lines.withColumn("gap", F.lead("y0").over(w) - F.col("y1")).where("gap is not null").groupBy("page").agg(F.median("gap").alias("gap"))


def passage_counts(passages: DataFrame) -> DataFrame:
    """Kinds of each book: passages, distinct ids and duplicates."""
    return passages.groupBy("book_id", "kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")).withColumn("duplicates", F.col("n") - F.col("n_ids"))


def printed_ranges(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """passages (id, book_id, pdf_start, pdf_end), pages (book_id, pdf_page, printed, reason) -> (id, first, last, reason).

    The printed range is known only if no page of it has a reason; else the reasons, each
    once and sorted, are joined. A page that is not in the table has none.
    """
    each = passages.select("id", "book_id", "pdf_start", "pdf_end", F.explode(F.sequence("pdf_start", "pdf_end")).alias("pdf_page"))
    met = each.join(pages.select("book_id", "pdf_page", "printed", "reason"), ["book_id", "pdf_page"], "left")
    at = lambda edge: F.max(F.when(F.col("pdf_page") == F.col(edge), F.col("printed")))
    why = F.array_join(F.sort_array(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))), ";")
    sums = met.groupBy("id").agg(at("pdf_start").alias("first"), at("pdf_end").alias("last"), F.nullif(why, F.lit("")).alias("reason"))
    known = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return sums.select("id", known("first"), known("last"), "reason")


def neighbour_candidates(pages: DataFrame) -> DataFrame:
    """pages (book_id, pdf_page, candidates) -> with neighbours: array<struct<offset, candidates>> of the pages two before to two after that are there."""
    w = Window.partitionBy("book_id").orderBy("pdf_page")
    steps = [(-2, F.lag("candidates", 2)), (-1, F.lag("candidates", 1)), (1, F.lead("candidates", 1)), (2, F.lead("candidates", 2))]
    each = [F.struct(F.lit(offset).alias("offset"), step.over(w).alias("candidates")) for offset, step in steps]
    return pages.withColumn("neighbours", F.filter(F.array(*each), lambda n: n["candidates"].isNotNull()))


def figure_nodes(figures: DataFrame) -> DataFrame:
    """figures (id, book_id, label, caption, pdf_page, printed, legend_page, legend_printed) -> index rows (id, book_id, kind, pdf_start, pdf_end, printed, text, caption, figure_page).

    A figure cites the page of its legend if it has one, and keeps that of its plate; its text is the label and the caption.
    """
    clean = lambda c: F.replace(F.col(c), F.char(F.lit(0)), F.lit(""))
    page = F.coalesce("legend_page", "pdf_page")
    printed = F.when(F.col("legend_page").isNotNull(), F.col("legend_printed")).otherwise(F.col("printed"))
    return figures.select("id", "book_id", F.lit("figure").alias("kind"), page.alias("pdf_start"), page.alias("pdf_end"), printed.alias("printed"), F.concat(clean("label"), F.lit("\n\n"), clean("caption")).alias("text"), clean("caption").alias("caption"), F.col("pdf_page").alias("figure_page"))


def index_rows(passages: DataFrame, figures: DataFrame) -> DataFrame:
    """Passages and, after them, figures as one table; columns that one lacks are null."""
    return passages.unionByName(figure_nodes(figures), allowMissingColumns=True)
