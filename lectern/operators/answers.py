"""Model replies: pluggable calls in batches, and the rules that an answer has to hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<sentences:array<struct<text:string,citations:array<string>>>>"
WORDS = 150


def with_reply(rows: DataFrame, ask: Callable[[list[str]], list[str | None]], prompt: str, out: str = "reply") -> DataFrame:
    """rows with the reply of a model to a prompt column; ``ask`` takes a batch, and what it fails on is null."""

    @F.pandas_udf("string")
    def call(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in prompts:
            yield pd.Series(ask(batch.tolist()), dtype=object)

    return rows.withColumn(out, call(F.col(prompt)))


def with_embedding(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimensions: int, text: str = "text", out: str = "embedding") -> DataFrame:
    """rows with an embedding of a text column; another length than ``dimensions`` is an error."""

    @F.pandas_udf("array<float>")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = embed(batch.tolist())
            if len(found) != len(batch) or any(len(v) != dimensions for v in found):
                raise ValueError("the model changed its dimensions or skipped a text")
            yield pd.Series(found, dtype=object)

    return rows.withColumn(out, call(F.col(text)))


def answer_of(reply: Column) -> Column:
    return F.from_json(reply, ANSWER)


def answer_holds(answer: Column, numbers: Column) -> Column:
    """Whether each sentence is one sentence without brackets and cites known numbers, in WORDS words at most."""
    good = lambda s: (
        (F.trim(s["text"]) != "")
        & ~s["text"].rlike(r"[.!?]\s+\S")
        & ~s["text"].contains("[")
        & (F.size(s["citations"]) > 0)
        & F.forall(s["citations"], lambda c: c.rlike("^[0-9]+$") & F.array_contains(numbers, c.try_cast("int")))
    )
    words = F.aggregate(answer["sentences"], F.lit(0), lambda n, s: n + F.size(F.filter(F.split(s["text"], r"(?U)\s+"), lambda w: w != "")))
    return F.coalesce((F.size(answer["sentences"]) > 0) & F.forall(answer["sentences"], lambda s: F.coalesce(good(s), F.lit(False))) & (words <= WORDS), F.lit(False))


def answer_text(answer: Column) -> Column:
    line = lambda s: F.concat(F.trim(s["text"]), F.lit(" "), F.array_join(F.transform(s["citations"], lambda c: F.concat(F.lit("["), c, F.lit("]"))), ""))
    return F.array_join(F.transform(answer["sentences"], line), "\n")


def with_role(text: Column, role: str, enabled: bool) -> Column:
    """The text that is embedded: with its role before it where the model asks for roles."""
    return F.concat(F.lit(f"{role}: "), text) if enabled else text
