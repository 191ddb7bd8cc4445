"""Exact vector search: a bounded block of questions against every row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions that one broadcast block holds; more questions take more passes over the index.
BLOCK = 4_096
#: Decimals of a score. Ranking on rounded scores makes ties of equal vectors the same everywhere.
DECIMALS = 9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length; another length is an error."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def top_k(questions: DataFrame, index: DataFrame, k: int = 10, skip_same_id: bool = False) -> DataFrame:
    """questions (qid, embedding), index (id, embedding) -> (qid, id, rank, score): the k rows of largest cosine.

    Exact: every row is scored, in double precision. Equal scores go by id. Filters on the
    index belong before this call, so that k rows are found among what they leave. Each
    batch keeps its own k best for a question; what is left is ranked by a window. Null
    embeddings are left out, and a vector of zeros scores 0.
    """
    asked = questions.where("embedding is not null").select("qid", "embedding")
    rows = index.where("embedding is not null").select("id", "embedding")
    qid, id_ = questions.schema["qid"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    count = asked.count()
    blocks = max(1, -(-count // BLOCK))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).collect() if blocks > 1 else asked.collect()
        sent = questions.sparkSession.sparkContext.broadcast(([r["qid"] for r in own], [list(r["embedding"]) for r in own]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, vectors = sent.value
            if not names:
                return
            unit = _unit(np.array(vectors, np.float64))
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = np.round(_unit(_matrix(batch.column(1))) @ unit.T, DECIMALS)
                ids = batch.column(0).to_pylist()
                order = sorted(range(len(ids)), key=ids.__getitem__)
                scores = np.ascontiguousarray(scores[order].T)
                place = {ids[o]: i for i, o in enumerate(order)}  # last place of an id, and first
                first = {ids[o]: i for i, o in reversed(list(enumerate(order)))}
                outs, rows, values = [], [], []
                for q, name in enumerate(names):
                    own = scores[q]
                    if skip_same_id and name in place:
                        own[first[name] : place[name] + 1] = -np.inf
                    least = np.partition(own, -k)[-k] if k < len(own) else -np.inf
                    near = np.flatnonzero(own >= least)  # in order of ids, which settles ties
                    best = near[np.argsort(-own[near], kind="stable")[:k]]
                    best = best[np.isfinite(own[best])]
                    outs += [name] * len(best)
                    rows += [ids[order[i]] for i in best]
                    values += own[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(outs, batch_type(qid)), pa.array(rows, batch.schema.field(0).type), pa.array(values)], names=["qid", "id", "score"])

        part = rows.mapInArrow(run, f"qid {qid}, id {id_}, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "id", "rank", "score")


def batch_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
