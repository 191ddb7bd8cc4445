"""State as tables: insert-missing ingest, keyed merges, first-write-wins caches, guarded exports, status."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Index tables that a status covers: one for each version and model.
TABLES = 1_000


def insert_missing(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows of incoming whose key the store lacks, each key once."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def ingest_summary(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """One row: passages, distinct ids, duplicates, present before, inserted."""
    ids = incoming.groupBy(key).agg(F.count("*").alias("n"))
    met = ids.join(stored.select(key).distinct().withColumn("held", F.lit(1)), key, "left")
    sums = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("passages"), F.count("*").alias("distinct_ids"), F.count("held").alias("present"))
    return sums.withColumns({"duplicates": F.col("passages") - F.col("distinct_ids"), "inserted": F.col("distinct_ids") - F.col("present")})


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """stored with changes in place of rows of the same keys; of several changes to a key the last by ``order``."""
    rest = [c for c in stored.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order or rest[0]).alias("_new"))
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*keys, "_new.*"))


def merge_update(stored: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """stored with ``columns`` set where a change has the same keys and a value; unmatched changes do nothing.

    Of several values for a key and column the last by ``order`` (or else the largest) counts, so that no row is doubled.
    """
    rows = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in columns} if order else {}
    own = changes.groupBy(*keys).agg(*[(F.max_by(c, rows[c]) if order else F.max(c)).alias(f"_{c}") for c in columns])
    met = stored.join(own, keys, "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def append_first(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First write wins: stored, and of each new key the first row by ``order``."""
    rest = [c for c in stored.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti"))


def register(registry: DataFrame, table: str, model: str, dimensions: int) -> DataFrame:
    """registry (table_name, model, dimensions) with the table in it; another model or dimension for it is an error."""
    held = registry.where(F.col("table_name") == table).select("model", "dimensions").first()
    if held is None:
        return registry.unionByName(registry.sparkSession.createDataFrame([(table, model, dimensions)], registry.schema))
    if tuple(held) != (model, dimensions):
        raise ValueError(f"{table} is registered with another model or dimension")
    return registry


def index_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """current (book_id, id), stored (table_name, id) -> per table and book: ids, stored ones, duplicates, complete."""
    ids = current.groupBy("book_id", "id").agg(F.count("*").alias("n"))
    books = ids.groupBy("book_id").agg(F.count("*").alias("ids"), (F.sum("n") - F.count("*")).alias("duplicates"))
    names = [r[0] for r in stored.select("table_name").distinct().limit(TABLES + 1).collect()]
    if len(names) > TABLES:
        raise ValueError(f"more than {TABLES} index tables")
    held = ids.join(stored.distinct(), "id").groupBy("table_name", "book_id").agg(F.count("*").alias("stored"))
    every = books.withColumn("table_name", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    return every.join(held, ["table_name", "book_id"], "left").withColumn("stored", F.coalesce("stored", F.lit(0))).withColumn("complete", F.col("stored") == F.col("ids"))


def copy_books(source: DataFrame, target: DataFrame, books: list[str]) -> DataFrame:
    """Rows of the books to carry from one index version to the next: those whose id the target lacks."""
    return source.where(F.col("book_id").isin(*books)).join(target.select("id"), "id", "left_anti")


def export(rows: DataFrame, path: str, order: list[str]) -> int:
    """Write rows as JSON lines by ``order``; refuse to replace more lines than there are rows. Returns the count.

    The lines go to a folder beside the target first. When they are whole, the old target is
    moved aside, the new one takes its place, and only then is the old one removed.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staged")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    count = rows.count()
    if files.exists(target) and spark.read.text(path).count() > count:
        raise ValueError(f"{path} holds more lines than there are rows")
    rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(staged.toString())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.replaced")
    if files.exists(target):
        files.delete(aside, True)
        if not files.rename(target, aside):
            raise OSError(f"{path} could not be moved aside")
    if not files.rename(staged, target):
        raise OSError(f"{path} could not be replaced; what it held is in {aside.toString()}")
    files.delete(aside, True)
    return count


def fresh(cache: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a cache whose fingerprint is still that of its inputs; a stale or unknown key gives none."""
    return cache.join(current.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_semi")


def fingerprints(inputs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One digest a key over its input rows (files, sizes, versions), whatever their order."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return inputs.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ","), 256).alias("fingerprint"))


def models(registry: DataFrame) -> DataFrame:
    """All registered tables by model and name."""
    return registry.orderBy("model", "table_name")


def model_of(registry: DataFrame, table: str, exists) -> tuple[str, int, bool] | None:
    """(model, dimensions, whether the physical table is there) of a registered table, or None; ``exists`` tells of a name."""
    held = registry.where(F.col("table_name") == table).select("model", "dimensions").first()
    return held and (held["model"], held["dimensions"], bool(exists(table)))


def question_row(questions: DataFrame) -> DataFrame:
    """questions (question, asker, language) -> rows of the log: an id, NULs taken out, and the defaults of what comes later."""
    clean = F.replace(F.col("question"), F.char(F.lit(0)), F.lit(""))
    none = F.array().cast("array<string>")
    return questions.select(
        F.expr("uuid()").alias("id"), clean.alias("question"), "asker", F.coalesce("language", F.lit("en")).alias("language"), F.current_timestamp().alias("asked_at"),
        none.alias("evidence"), none.alias("grades"), F.lit(0).alias("ungraded_count"), F.lit(None).cast("string").alias("answer"),
    )


def widened(stored: DataFrame, schema: DataFrame) -> DataFrame:
    """stored with the columns that a newer, empty table has besides, as nulls: a schema only grows."""
    return stored.unionByName(schema.limit(0), allowMissingColumns=True)


def appended(history: DataFrame, event: DataFrame, time: str = "time") -> DataFrame:
    """An append-only history with one more event, stamped with the time of writing."""
    return history.unionByName(event.withColumn(time, F.current_timestamp()), allowMissingColumns=True)


def outside_checkout(path: str) -> Path:
    """The path, refused if it or a folder above it is a version-controlled checkout: what is exported must not be committed."""
    own = Path(path).resolve()
    if any((folder / ".git").exists() for folder in (own, *own.parents)):
        raise ValueError(f"{path} is inside a checkout")
    return own
