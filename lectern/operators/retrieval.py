"""Search results: kind filter, neighbours, figure links, the figure budget, groups and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIGURE_ID, figure_key, language_code
from ..functions.vectors import top_k

# Kinds that are searched, and words of a neighbour that are shown.
SEARCH_KINDS = ("content", "summary", "glossary")
NEIGHBOUR_WORDS = 120
#: A printed mention of a figure.
MENTION = rf"(?iU)\b(?:fig(?:ure|ura)?s?\.?|ilustraci[oó]n|abbildung)\s*({FIGURE_ID})\b"


def search(questions: DataFrame, index: DataFrame, k: int = 10, kinds: tuple[str, ...] | None = SEARCH_KINDS, skip_same_id: bool = False) -> DataFrame:
    """Exact top k among the rows of the given kinds: the filter comes before the cut."""
    return top_k(questions, index.where(F.col("kind").isin(*kinds)) if kinds else index, k, skip_same_id)


def neighbours(passages: DataFrame) -> DataFrame:
    """passages (book_id, ord, id, section_path) -> with before and after: the ids of adjacent rows of the same section."""
    w = Window.partitionBy("book_id").orderBy("ord")
    same = lambda step: F.when(step("section_path").over(w).eqNullSafe(F.col("section_path")), step("id").over(w))
    return passages.withColumns({"before": same(F.lag), "after": same(F.lead)})


def capped(text: Column, words: int = NEIGHBOUR_WORDS) -> Column:
    """struct(text, truncated): at most so many words of a neighbour."""
    own = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    cut = F.size(own) > words
    return F.struct(F.when(cut, F.array_join(F.slice(own, 1, words), " ")).otherwise(text).alias("text"), cut.alias("truncated"))


def neighbour_texts(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """hits (id) joined to the capped texts of what stands before and after: (id, side, neighbour, text, truncated)."""
    linked = neighbours(passages).select("id", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("n")), F.struct(F.lit("after").alias("side"), F.col("after").alias("n")))).alias("x"))
    wanted = linked.join(hits.select("id").distinct(), "id").select("id", "x.side", F.col("x.n").alias("neighbour")).where("neighbour is not null")
    texts = passages.select(F.col("id").alias("neighbour"), capped(F.col("text")).alias("c"))
    return wanted.join(texts, "neighbour").select("id", "side", "neighbour", "c.text", "c.truncated")


def figure_links(passages: DataFrame, figures: DataFrame) -> DataFrame:
    """Passages joined to the figures that their text mentions, within a book: (id, figure_id, ord), in figure order."""
    said = passages.select("id", "book_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)))).alias("mention"))
    keyed = said.withColumn("key", figure_key(F.col("mention")))
    named = figures.select("book_id", F.col("id").alias("figure_id"), figure_key(F.col("identifier")).alias("key"), "ord")
    return keyed.join(named, ["book_id", "key"]).select("id", "figure_id", "ord").distinct()


def figure_budget(direct: DataFrame, linked: DataFrame, limit: int = 4) -> DataFrame:
    """direct (qid, id, rank, score), linked (qid, id, passage_rank, pos, score) -> (qid, id, position, score, origin).

    The first half of the budget goes to direct hits, then linked figures follow in passage
    order with their passage's score, then the other direct hits; an id is taken once.
    """
    half = limit // 2
    tiers = direct.select("qid", "id", F.when(F.col("rank") <= half, 0).otherwise(2).alias("tier"), F.col("rank").alias("a"), F.lit(0).alias("b"), "score", F.lit("direct").alias("origin"))
    tiers = tiers.unionByName(linked.select("qid", "id", F.lit(1).alias("tier"), F.col("passage_rank").alias("a"), F.col("pos").alias("b"), "score", F.lit("linked").alias("origin")))
    order = ["tier", "a", "b", "id"]
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy(*order))
    position = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return tiers.withColumn("n", first).where("n = 1").withColumn("position", position).where(F.col("position") <= limit).select("qid", "id", "position", "score", "origin")


def group_evidence(candidates: DataFrame, question_language: str = "en") -> DataFrame:
    """candidates (qid, book_id, rank, score, flag, language) that pass, grouped by book and numbered from 1.

    Only a true flag passes. Rows go by score within a book and books by their best score;
    nulls are least, ties keep the order of rank, and of first appearance among books.
    """
    passing = candidates.where(F.col("flag").eqNullSafe(F.lit(True)))
    book = Window.partitionBy("qid", "book_id")
    ranked = passing.withColumns({"best": F.max("score").over(book), "book_pos": F.min("rank").over(book)})
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("best"), "book_pos", F.desc_nulls_last("score"), "rank")
    offered = ~language_code(F.col("language")).eqNullSafe(F.lit(question_language))
    return ranked.withColumns({"number": F.row_number().over(order), "translation_available": offered}).drop("best", "book_pos")


def with_links(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """candidates (book_id, id, ...) with links: array<struct<start, end, kind, target>> of links (book_id, id, start, end, kind, target), empty without any."""
    own = links.groupBy("book_id", "id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "target"))).alias("links"))
    met = candidates.join(own, ["book_id", "id"], "left")
    return met.withColumn("links", F.coalesce("links", F.array().cast(own.schema["links"].dataType)))


def with_flags(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """candidates (qid, rank, ...) with the flag of the same place in flags (qid, rank, flag); another number of them is an error."""
    met = candidates.withColumn("_c", F.lit(True)).join(flags.select("qid", "rank", "flag", F.lit(True).alias("_f")), ["qid", "rank"], "full")
    whole = F.assert_true(F.col("_c").isNotNull() & F.col("_f").isNotNull(), "as many flags as candidates are needed")
    return met.withColumn("_ok", whole).where("_ok is null").select(*candidates.columns, "flag")


def evidence_of(nodes: DataFrame) -> DataFrame:
    """nodes (id, text, metadata: JSON) -> the fields that evidence shows, with defaults for what older metadata lacks.

    The text is the caption where there is one.
    """
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    return nodes.select(
        "id",
        F.coalesce(field("caption"), F.col("text")).alias("text"),
        field("book_id").alias("book_id"),
        F.coalesce(field("kind"), F.lit("content")).alias("kind"),
        F.coalesce(field("text_source"), F.lit("born-digital")).alias("text_source"),
        field("pdf_start").cast("int").alias("pdf_start"),
        F.coalesce(field("pdf_end"), field("pdf_start")).cast("int").alias("pdf_end"),
        F.coalesce(field("check_page").cast("boolean"), F.lit(False)).alias("check_page"),
        F.coalesce(F.from_json(field("section_path"), "array<string>"), F.array().cast("array<string>")).alias("section_path"),
        F.coalesce(F.from_json(field("figures"), "array<string>"), F.array().cast("array<string>")).alias("figures"),
    )
