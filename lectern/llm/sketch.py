"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of all hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, unused

#: Words of a shingle.
WIDTH = 5
#: One hash in 2 ** SCALE_BITS is retained.
SCALE_BITS = 2
#: Ids of a range that is ordered on its own. There are as many ranges as ids need, so that one row of each (all that
#: is broadcast or ordered in one place) is a millionth of the ids.
RANGE_ROWS = 1_000_000


def with_sketch(df: DataFrame, text_col: str, out: str, width: int = WIDTH, scale_bits: int = SCALE_BITS) -> DataFrame:
    """df with a column ``out``: the sorted distinct retained hashes (array of long) of the text.

    Words are lower-cased and end at ASCII white space; a shingle is ``width`` words, and a
    text of fewer words (but not none) is one shingle. A hash is retained if its highest
    ``scale_bits`` bits are zero, so sketches of any texts can be merged by a union. A text
    none of whose hashes is that small keeps its least one as a witness, so that two short
    texts aren't taken for equal. Null and empty texts have an empty sketch.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    h, s, k = (unused(c, df) for c in ("hashes", "shingles", "kept"))
    shingles = F.when(F.size(h) >= width, _rolled(h, width)).when(F.size(h) > 0, F.array(F.expr(f"aggregate(`{h}`, 42L, (s, x) -> xxhash64(s, x))"))).otherwise(F.array().cast("array<bigint>"))
    kept = F.filter(s, lambda x: F.shiftrightunsigned(x, 64 - scale_bits) == 0) if scale_bits else F.col(s)
    return (
        df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn(s, shingles)
        .drop(h)
        .withColumn(k, kept)
        .withColumn(out, F.sort_array(F.array_distinct(F.when((F.size(k) == 0) & (F.size(s) > 0), F.array(F.array_min(s))).otherwise(F.col(k)))))
        .drop(s, k)
    )


def _rolled(hashes: str, width: int) -> Column:
    inner = ", ".join(f"`{hashes}`[i + {k}]" for k in range(1, width))
    rest = f", {inner}" if inner else ""
    return F.expr(f"transform(slice(`{hashes}`, 1, size(`{hashes}`) - {width - 1}), (x, i) -> xxhash64(x{rest}))")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sketches; 1 for two empty ones, 0 for one."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(part: str, whole: str) -> Column:
    """Share of ``part`` that ``whole`` has, whatever their sizes; 1 if ``part`` is empty."""
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def merged(a: str, b: str, scale_bits: int = SCALE_BITS) -> Column:
    """Sketch of two texts taken together; a witness goes once a retained hash is there."""
    union = F.sort_array(F.array_union(a, b))
    kept = F.filter(union, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(union, 1, 1))


def fingerprint(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def neighbours(ids: DataFrame) -> DataFrame:
    """(doc_id, need), one row an id -> (doc_id, before_id, before_need): the id before it in descending order.

    The first id's is the last one's: the order closes to a ring. A null id comes last. Spark
    deals the ids out by range, as many ranges as RANGE_ROWS asks for; each is ordered on its
    own, and only one row of each range is ordered in one place.
    """
    spark = ids.sparkSession
    held = cut(ids)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + held.count() // RANGE_ROWS)
    # Written, so that a range stays the same when a lost task runs again.
    of_range = cut(held.repartitionByRange(ranges, F.desc_nulls_last("doc_id")).withColumn("range", F.spark_partition_id()))
    own = F.struct("doc_id", "need")
    down = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"))
    last = of_range.groupBy("range").agg(F.min(F.struct(F.isnotnull("doc_id").alias("has"), "doc_id", "need")).alias("last"))
    ring = Window.orderBy("range")
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = last.select("range", F.coalesce(F.lag("last").over(ring), F.last("last").over(everything)).alias("entry"))
    inside = of_range.withColumn("before", F.lag(own).over(down))
    before = F.coalesce("before", F.struct("entry.doc_id", "entry.need"))
    return inside.join(F.broadcast(entry), "range").select("doc_id", before["doc_id"].alias("before_id"), before["need"].alias("before_need"))


def edit_study(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> each text's sketch beside those of its edited text and of the next document.

    The edited text has its last third replaced by the first code points of the next
    document, in descending order of doc_id. Of rows that repeat an id, all are compared,
    and the one with the least text hash stands for the id where it is next. Null texts are
    empty. Only the part of a text that its neighbour takes, and its sketch, go to it.
    """
    kind = docs.schema["doc_id"].dataType
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  never null, so that joins and windows share a partitioning
    texts = docs.select(key("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).groupBy("doc_id").agg(F.max(F.floor(F.col("n") / 3)).alias("need"))
    order = neighbours(ids).select(key("doc_id").alias("_k"), key("before_id").alias("to"), "before_need")
    # Sketches are made again after the shuffle: hashing is cheaper than moving what it gives.
    first = Window.partitionBy("k").orderBy(F.xxhash64("text"))
    sent = (
        texts.join(order, F.col("k") == F.col("_k"))
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select("to", F.expr("substring(text, 1, int(before_need))").alias("head"), "text")
    )
    sent = with_sketch(sent, "text", "next_sketch").drop("text")
    n = F.length("text")
    cut_at = n - F.floor(n / 3)
    edited = texts.join(sent, F.col("k") == F.col("to")).select(
        F.when(F.col("k") != "", F.col("k").try_cast(kind)).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), cut_at.cast("int")), F.substring("head", F.lit(1), (n - cut_at).cast("int"))).alias("edited"),
        "text",
        "next_sketch",
    )
    return with_sketch(with_sketch(edited, "text", "sketch").drop("text"), "edited", "edited_sketch")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of each row of documents and of its edited text; nulls, ties and repeats as in edit_study().

    Besides the contract's columns, ``held_in_next`` is the share of the fingerprint that the
    next document's has, which is what a short text in a long one is found by.
    """
    return edit_study(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"),
        fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "next_sketch").alias("held_in_next"),
    )
