"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

#: Bytes of text that are encoded at once (a longer piece goes alone).
BATCH_BYTES = 1 << 20
#: Pieces whose counts a worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 18
#: Largest vocabulary file that is sent to the workers.
FILE_BYTES = 64 << 20


_SPACES = dict.fromkeys(map(ord, "\t\n\r"), " ")

# Fixed value: the pre-tokenizer's pattern of the vocabulary whose white space is a safe boundary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def safe_spaces(data: bytes, name: str) -> bool:
    """Whether the file's own settings make white space a safe boundary.

    They do if its pre-tokenizer first cuts the text into the matches of WORD_PATTERN and drops
    the rest, as no match holds white space; its normalizer does nothing but NFC, lower case
    and evening out white space; and no added token holds white space or takes it from
    beside it. All else is encoded whole.
    """
    if not name.endswith(".json"):
        return False
    own = json.loads(data)
    steps = lambda x, inner: [] if not x else x[inner] if x["type"] == "Sequence" else [x]
    plain = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ")
        for n in steps(own.get("normalizer"), "normalizers")
    )
    first = (steps(own.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    cuts = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    added = own.get("added_tokens", [])
    return plain and cuts and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in added)


class Counter:
    """Tokens of a text, as the sum over the pieces between white space.

    The vocabulary drops white space before it merges anything: no token reaches across it,
    NFC composes nothing with it, and no special string holds any. So it is a safe boundary,
    each distinct piece is encoded once, and a long text costs its pieces. Other white space
    than these four characters stays inside the pieces, where the library drops it.
    """

    def __init__(self, encode: Callable[[list[str]], list[int]]):
        self.encode, self.known = encode, {}

    def counts(self, texts: list[str]) -> list[int]:
        split = [t.translate(_SPACES).split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = sorted(p for p in set().union(*split) if p not in known)
        for batch in groups(new):
            known.update(zip(batch, self.encode(batch)))
        return [sum(map(known.__getitem__, s)) for s in split]


def load(data: bytes, name: str) -> Callable[[list[str]], list[int]]:
    """Lengths of texts by the library for the file: tokenizers for .json, sentencepiece for .model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(data.decode())
        own.no_truncation()
        own.no_padding()
        return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {name}")


def n_bytes(texts: list[str]) -> list[int]:
    """UTF-8 bytes of each text."""
    return [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]


def groups(texts: list[str], sizes: list[int] | None = None) -> Iterator[list[str]]:
    """texts in order, in batches of BATCH_BYTES at most, unless one text is larger."""
    own, size = [], 0
    for t, n in zip(texts, sizes or n_bytes(texts)):
        if own and size + n > BATCH_BYTES:
            yield own
            own, size = [], 0
        own.append(t)
        size += n
    if own:
        yield own


_OWN: dict[int, Callable[[list[str]], list[int]]] = {}


def _counter(data: bytes, name: str, between_spaces: bool) -> Callable[[list[str]], list[int]]:
    """One encoder to a worker, with the pieces that it remembers: both outlive a task."""
    key = hash((data, name, between_spaces))
    if key not in _OWN:
        _OWN.clear()
        encode = load(data, name)
        _OWN[key] = Counter(encode).counts if between_spaces else encode
    return _OWN[key]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", between_spaces: bool | None = None) -> DataFrame:
    """docs -> (id, n_bytes, n_tokens), one row for each row of docs.

    ``between_spaces`` says that white space is a safe boundary of the vocabulary; None reads
    that from the file (see safe_spaces()), and True for a file that doesn't say so is an
    error. Otherwise whole texts are encoded. A null or empty text has no bytes and no
    tokens. Repeated rows are counted each; other columns are not read; an empty table gives
    no rows. The file is read on the driver and broadcast, up to FILE_BYTES.
    """
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    with open(path, "rb") as f:
        data, name = f.read(), os.path.basename(path)
    safe = safe_spaces(data, name)
    if between_spaces and not safe:
        raise ValueError(f"{name} doesn't make white space a safe boundary")
    sent, cuts = docs.sparkSession.sparkContext.broadcast(data), safe if between_spaces is None else between_spaces
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value, name, cuts)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = n_bytes(texts)
            tokens = [n for group in groups(texts, sizes) for n in count(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(texts, run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of documents; a null text has none."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
