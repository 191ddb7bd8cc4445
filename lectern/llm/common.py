"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z only, unlike lower(): contracts on words fold ASCII letters alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a batch that goes to a Python worker.
ARROW_BYTES = 8 << 20
#: Ids that may be broadcast to drop rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """name, with underscores put before it until df has no such column (Spark doesn't tell cases apart)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def shared(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where both are unset, a local session gets a temporary folder, and a cluster is an
    error: executors don't see each other's disks.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to a new folder of the shared one and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared(spark)}/lectern-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.written_to = path
    return held


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; release() removes it."""
    return written(df, "step")


def release(*frames: DataFrame | None) -> None:
    """Remove what cut() or written() wrote for these; only when nothing lazy reads it any more."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with what it freed given back to the system at its end: workers are used again by the next stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(), in batches of ARROW_BYTES at most (or one row), whatever the length of texts.

    The bound is a setting of the session, which is lowered to it where it is higher: each
    running task holds a few batches beside the heap of its executor, and as much in Python.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not held or int(held[1]) > ARROW_BYTES:
        conf.set(name, f"{ARROW_BYTES}b")
    return df.mapInArrow(tidy(run), schema)


def forget(spark: SparkSession) -> None:
    """Let Spark drop the shuffles and broadcasts of finished steps, on all executors.

    Its cleaner does so once the driver's collector finds them unused, which in a heap with
    room can be hours later; a chain of many steps would fill disks and memory until then.
    """
    spark.sparkContext._jvm.System.gc()


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is among ids (one column); a null id equals a null.

    The ids are broadcast if they are counted to be BROADCAST_IDS at most, so that no text
    is shuffled; beyond that both sides are shuffled by id.
    """
    name = unused("_id", docs)
    ids = ids.toDF(name).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col].eqNullSafe(F.col(name)), "left_anti")
