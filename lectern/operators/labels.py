"""Labels and the question log: filters, label states, suggested pages, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_listing(log: DataFrame, labels: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Questions of inclusive UTC days, newest first, with the state of their label; asker and feedback stay unread."""
    day = F.to_date("asked_at")
    rows = log
    if since:
        rows = rows.where(day >= F.lit(since).cast("date"))
    if until:
        rows = rows.where(day <= F.lit(until).cast("date"))
    state = F.when(F.col("expect_not_found").isNull(), F.lit("unlabelled")).when(F.col("expect_not_found"), F.lit("out of the sources")).otherwise(F.lit("in scope"))
    own = labels.groupBy(F.col("log_id").alias("id")).agg(F.max("expect_not_found").alias("expect_not_found"))  # one label to a question
    return rows.join(own, "id", "left").withColumn("state", state).drop("expect_not_found")


def owned(log: DataFrame, evidence: DataFrame, identity: str, asker: str) -> DataFrame:
    """Evidence (question, id) of one question of one asker whose grade in the log is true; a log without grades gives none."""
    mine = log.where((F.col("id") == identity) & (F.col("asker") == asker))
    good = mine.select(F.col("id").alias("question"), F.explode("grades").alias("g")).where(F.col("g.grade").eqNullSafe(F.lit(True))).select("question", F.col("g.id").alias("id"))
    return evidence.join(good, ["question", "id"], "left_semi")


def suggested_pages(candidates: DataFrame) -> DataFrame:
    """candidates (qid, book, pdf_start, pdf_end, rank, grade, wider) -> (qid, book, page, position, passed), each page once.

    Logged candidates graded true come first, then the other logged ones, then wider hits,
    each by rank and page; ``passed`` is that of the first occurrence.
    """
    passed = F.coalesce("grade", F.lit(False)) & ~F.col("wider")
    tier = F.when(F.col("wider"), 2).when(passed, 0).otherwise(1)
    pages = candidates.select("qid", "book", "rank", tier.alias("tier"), passed.alias("passed"), F.explode(F.sequence("pdf_start", "pdf_end")).alias("page"))
    order = ["tier", "rank", "page", "book"]
    first = F.row_number().over(Window.partitionBy("qid", "book", "page").orderBy(*order))
    position = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return pages.withColumn("n", first).where("n = 1").withColumn("position", position).select("qid", "book", "page", "position", "passed")


def recover(logged: DataFrame, *tables: DataFrame) -> DataFrame:
    """logged (qid, id, rank) with the node (book_id, pdf_start, pdf_end) of the first table that has the id; unresolved stays null."""
    rows = logged
    columns = ["book_id", "pdf_start", "pdf_end"]
    for k, t in enumerate(tables):
        rows = rows.join(t.groupBy("id").agg(F.min(F.struct(*columns)).alias(f"_n{k}")), "id", "left")
    node = F.coalesce(*[F.col(f"_n{k}") for k in range(len(tables))])
    return rows.withColumn("_n", node).select(*logged.columns, *[F.col(f"_n.{c}").alias(c) for c in columns])


def label_pages(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """labels (log_id, book, page), changes (log_id, action, book, page) -> label records after the changes.

    add and remove take one page; outside and clear take the whole label. A label that loses
    its last page is gone. One change to a label and page: (log_id, expect_not_found,
    evidence array<struct<book, pages>>), books and pages sorted.
    """
    whole = changes.where("action in ('outside', 'clear')").select("log_id", "action").distinct()
    kept = labels.join(whole, "log_id", "left_anti").unionByName(changes.where("action = 'add'").select("log_id", "book", "page")).distinct()
    left = kept.join(changes.where("action = 'remove'"), ["log_id", "book", "page"], "left_anti")
    books = left.groupBy("log_id", "book").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    records = books.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("book", "pages"))).alias("evidence")).withColumn("expect_not_found", F.lit(False))
    outside = whole.where("action = 'outside'").select("log_id", F.array().cast(records.schema["evidence"].dataType).alias("evidence"), F.lit(True).alias("expect_not_found"))
    return records.unionByName(outside)


def expected_pages(evidence: DataFrame, books: DataFrame) -> DataFrame:
    """evidence (qid, book: as evaluation sets name it, pages array<int>), books (id, eval_book) -> (qid, book_id, page), each once.

    Books that the catalogue doesn't map are dropped.
    """
    known = books.where("eval_book is not null").select(F.col("eval_book").alias("book"), F.col("id").alias("book_id"))
    return evidence.join(known, "book").select("qid", "book_id", F.explode("pages").alias("page")).distinct()
