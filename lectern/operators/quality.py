"""Reading quality: the queue of failing pages, its summary, the best attempt, resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def queue(readings: DataFrame, resolutions: DataFrame, book: str | None = None, reason: str | None = None) -> DataFrame:
    """readings (book_id, pdf_page, rules_failed) that fail a rule and have no resolution."""
    rows = readings.where(F.size("rules_failed") > 0)
    if book:
        rows = rows.where(F.col("book_id") == book)
    if reason:
        rows = rows.where(F.array_contains("rules_failed", reason))
    return rows.join(resolutions.select("book_id", "pdf_page"), ["book_id", "pdf_page"], "left_anti")


def reasons(readings: DataFrame) -> DataFrame:
    return readings.select(F.explode("rules_failed").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def indexed_quantiles(values: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0, 0.5, 0.9, 0.95, 0.99, 1)) -> DataFrame:
    """Value at index int((n - 1) * q) of the sorted values of each group, for each q: (by, q, value).

    Equal values are counted before anything is sorted, so that a group costs its distinct
    values: they are ranked by running sums, and those that a point falls on are kept.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"_to": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    asked = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.floor((F.col("_n") - 1) * F.lit(float(q))).alias("at")) for q in points])).alias("p")
    found = ranked.select(*by, value, "_c", "_to", asked).where("p.at < _to and p.at >= _to - _c")
    return found.select(*by, F.col("p.q").alias("q"), F.col(value).alias("value"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """attempts (book_id, pdf_page, n, timed_out, rules_failed, rotated, hinted, text) -> the best unhinted one of each page."""
    worth = F.struct(F.col("timed_out").cast("int"), F.size("rules_failed"), F.col("rotated").cast("int"), "n")
    return attempts.where(~F.col("hinted")).groupBy("book_id", "pdf_page").agg(F.min_by(F.struct("n", "rules_failed", "rotated", "text"), worth).alias("best")).select("book_id", "pdf_page", "best.*")


def overlaid(pages: DataFrame, readings: DataFrame, resolutions: DataFrame) -> DataFrame:
    """pages (book_id, pdf_page, text, source) under kept readings and, above all, resolutions; hidden pages keep their own."""
    keys = ["book_id", "pdf_page"]
    met = pages.join(readings.select(*keys, F.col("text").alias("reading")), keys, "left").join(resolutions.select(*keys, F.col("text").alias("resolved")), keys, "left")
    own = F.col("source") == "hidden"
    text = F.when(own, F.col("text")).otherwise(F.coalesce("resolved", "reading", "text"))
    source = F.when(own, F.col("source")).when(F.col("resolved").isNotNull() | F.col("reading").isNotNull(), F.lit("ocr")).otherwise(F.col("source"))
    return met.select(*keys, text.alias("text"), source.alias("source"), F.col("resolved").isNotNull().alias("is_resolved"))


def latest(history: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Last event of each key in an append-only history."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("last")).select(*keys, "last.*")
