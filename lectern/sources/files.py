"""File sources: the book catalogue, evaluation sets with quarantine, runs, versioned records, binary pages."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOOKS = "id string, filename string, title string, language string, eval_book string"
BOOK_ID = r"[a-z0-9][a-z0-9_-]{0,63}"
PAGE = "struct<pdf:int,pdf_from:int,pdf_to:int,text:string>"
RECORD = f"id string, set_version int, status string, question string, language string, type string, subject string, expect_not_found boolean, log_id string, evidence array<struct<book:string,work:string,state:string,pages:array<{PAGE}>>>"
STATUSES, STATES, ASKED = ("draft", "pages_open", "confirmed", "retired"), ("confirmed", "open"), ("en", "es", "ca")
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"


def catalogue(spark: SparkSession, text: str) -> DataFrame:
    """Books of a TOML catalogue; the first bad row fails the whole load."""
    rows, seen, evals = [], set(), set()
    for book in tomllib.loads(text).get("books", []):
        row = tuple(book.get(k) for k in ("id", "filename", "title", "language", "eval_book"))
        name, file, title, language, eval_book = row
        if not re.fullmatch(BOOK_ID, name or "") or name in seen:
            raise ValueError(f"book id {name!r} is malformed or repeated")
        if not isinstance(file, str) or not file.lower().endswith(".pdf") or "/" in file or "\\" in file:
            raise ValueError(f"{name}: the file name must be a bare .pdf name")
        if not (title or "").strip() or not (language or "").strip():
            raise ValueError(f"{name}: title and language must not be blank")
        if eval_book is not None and eval_book in evals:
            raise ValueError(f"{name}: eval_book is repeated")
        seen.add(name)
        evals.add(eval_book)
        rows.append(row)
    return spark.createDataFrame(rows, BOOKS)


def eval_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines (line, value) of a JSON-lines set -> (records, quarantine (name, line, reason)).

    Blank lines are skipped. The first line with an id takes it, even if that line is bad.
    Quarantined lines are named by id, or by number if the id isn't fit to print; reasons
    never hold text of the set.
    """
    own = lines.where(F.trim("value") != "").withColumn("data", F.from_json("value", f"{RECORD}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    d = lambda c: F.col(f"data.{c}")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    named = own.withColumn("id", F.get_json_object("value", "$.id")).withColumn("nth", F.when(F.col("id").isNull(), 1).otherwise(nth))
    items = lambda test: F.exists(d("evidence"), test)
    whole = lambda p: (p["pdf"].isNotNull() & p["pdf_from"].isNull() & p["pdf_to"].isNull()) | (p["pdf"].isNull() & (p["pdf_from"] <= p["pdf_to"]))
    reason = (
        F.when(d("_bad").isNotNull() & F.col("id").isNull(), F.lit("not a JSON object"))
        .when(~F.coalesce(F.col("id").rlike(SAFE_ID), F.lit(False)), F.lit("bad id"))
        .when(F.col("nth") > 1, F.lit("repeated id"))
        .when(d("_bad").isNotNull(), F.lit("a value of the wrong type"))
        .when(~F.coalesce(d("status").isin(*STATUSES), F.lit(False)), F.lit("bad status"))
        .when(~F.coalesce(d("language").isin(*ASKED), F.lit(False)), F.lit("bad language"))
        .when(F.coalesce(F.trim(d("question")), F.lit("")) == "", F.lit("no question"))
        .when(d("set_version").isNull() | d("expect_not_found").isNull(), F.lit("a field is missing"))
        .when(F.coalesce(items(lambda e: F.exists(e["pages"], lambda p: ~F.coalesce(whole(p), F.lit(False)))), F.lit(False)), F.lit("bad pages"))
    )
    judged = named.withColumn("reason", reason)
    safe = F.when(F.col("id").rlike(SAFE_ID), F.col("id")).otherwise(F.concat(F.lit("line "), F.col("line").cast("string")))
    return judged.where("reason is null").select("line", "data.*").drop("_bad"), judged.where("reason is not null").select(safe.alias("name"), "line", "reason")


def run_of(spark: SparkSession, path: str, kind: str, version: int = 1) -> DataFrame:
    """A run file, refused unless it says that it is one."""
    run = spark.read.json(path, multiLine=True)
    ok = {"kind", "format"} <= set(run.columns) and run.where((F.col("kind") == kind) & (F.col("format") == version)).count() == run.count()
    if not ok:
        raise ValueError(f"{path} is no run of this kind and format")
    return run


def kept_records(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """Kept readings of the current method; records of other methods count as absent."""
    return spark.read.schema(schema).json(path).where(F.col("method_version") == version)


def binary_pages(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Page images (path, length, content) for functions over binary columns."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def label_lines(lines: DataFrame) -> DataFrame:
    """lines (line, value) of a label file -> records; any malformed line or repeated id fails the whole load. Blank lines are skipped."""
    records, bad = eval_lines(lines)
    if first := bad.orderBy("line").first():
        raise ValueError(f"label {first['name']}: {first['reason']}")
    return records
