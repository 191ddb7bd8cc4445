"""Benchmark decontamination: suffix arrays over the training text, searched for every suffix of the tests.

Each batch of documents is a shard. Its suffix array holds the places where a test suffix
can match; every test suffix is looked up by binary search, and what it finds is joined to
the longest verbatim matches with their places in document and item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table, without_ids

#: Consecutive words of a window.
WINDOW = 13
#: Bytes of benchmark text that one broadcast block may hold; a larger benchmark goes in several blocks.
BLOCK_BYTES = 64 << 20
#: Bytes of document text to a shard, unless one document is longer.
SHARD_BYTES = 4 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if (c + 32 if 65 <= c <= 90 else c) in _KEPT else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, runs of 0-9, a-z and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Windows:
    """The distinct windows of one size: where each stands first, and all places of it."""

    size: int
    first: np.ndarray  # a place of each distinct window
    rank: np.ndarray  # of each place in the tests: the number of its window, or -1
    by_left: np.ndarray  # places of windows by rank and by the rank of the place before
    left_key: np.ndarray  # of by_left
    by_right: np.ndarray  # likewise by the rank of the place after
    right_key: np.ndarray


@dataclass
class Tests:
    """Words of the items as numbers above 0, one item after another, each followed by a 0."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    item: np.ndarray  # of each place in words
    offset: np.ndarray  # of each place in its item
    windows: list[Windows]
    names: list[str]
    least: int  # words of the shortest window
    most: int  # and of the longest


def _ranks(words: np.ndarray, size: int) -> np.ndarray:
    """Numbers that are equal where the next ``size`` words are (prefix doubling)."""
    rank, known = np.concatenate((words, [0])), 1
    shift = lambda by: np.concatenate((rank[by:], np.zeros(min(by, len(rank)), rank.dtype)))[: len(rank)]
    while 2 * known <= size:
        _, rank = np.unique(rank * (int(rank.max()) + 1) + shift(known), return_inverse=True)
        known *= 2
    if known < size:
        _, rank = np.unique(rank * (int(rank.max()) + 1) + shift(size - known), return_inverse=True)
    return rank[:-1]


def _beside(rank: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
    """rank of the place before (-1) or after (1) each, -1 where there is none."""
    at = places + step
    ok = (at >= 0) & (at < len(rank))
    return np.where(ok, rank[np.where(ok, at, 0)], -1)


def _key(rank: np.ndarray, beside: np.ndarray, n: int) -> np.ndarray:
    return rank * (n + 1) + beside + 1


def windows_of(words: np.ndarray, places: np.ndarray, size: int) -> Windows:
    _, first, own = np.unique(_ranks(words, size)[places], return_index=True, return_inverse=True)
    rank, n = np.full(len(words), -1, np.int64), len(first)
    rank[places] = own
    sides = []
    for step in (-1, 1):
        key = _key(own, _beside(rank, places, step), n)
        order = np.argsort(key, kind="stable")
        sides += [places[order], key[order]]
    return Windows(size, places[first], rank, *sides)


def prepare(items: list[tuple[str, str | None]], window: int = WINDOW) -> Tests:
    vocabulary: dict[bytes, int] = {}
    words, item, offset, names = [], [], [], []
    starts: dict[int, list[int]] = {}
    for name, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        if not own:
            continue
        size = min(window, len(own))
        starts.setdefault(size, []).extend(range(len(words), len(words) + len(own) - size + 1))
        words += [*own, 0]
        item += [len(names)] * (len(own) + 1)
        offset += range(len(own) + 1)
        names.append(name)
    a = lambda x: np.array(x, np.int64)
    every = [windows_of(a(words), a(places), size) for size, places in sorted(starts.items())]
    return Tests(vocabulary, a(words), a(item), a(offset), every, names, min(starts, default=window), max(starts, default=window))


def suffix_array(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places sorted by the first ``depth`` words that follow them (at least); words end in a 0."""
    rank = np.concatenate((words, [0]))
    known = 1
    while known < depth:  # prefix doubling: a rank stands for the first 2 * known words
        ahead = np.zeros_like(rank)
        ahead[:-known] = rank[known:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + np.where(rank > 0, ahead, 0), return_inverse=True)
        known *= 2
    return places[np.argsort(rank[places], kind="stable")]


def _bounds(words: np.ndarray, array: np.ndarray, tests: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct window, where its matches begin and end in the suffix array, by binary search."""

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(w.first), np.int64), np.full(len(w.first), len(array), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at, state = array[np.minimum(mid, len(array) - 1)], np.zeros(len(low), np.int8)
            for k in range(w.size):
                todo = np.flatnonzero(open_ & (state == 0))
                if not len(todo):
                    break
                x, y = words[np.minimum(at[todo] + k, len(words) - 1)], tests[w.first[todo] + k]
                state[todo] = np.sign(x - y)
            right = open_ & ((state < 0) | (after & (state == 0)))
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low

    return search(False), search(True)


def _ends(rank: np.ndarray, places: np.ndarray, step: int, held: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in the text, place in the tests) of equal windows whose neighbours on one side aren't equal too.

    Of all places of a window in the tests, which lie side by side by the window beside them,
    the block with the text's own neighbour is left out, so that only ends are written out.
    """
    own, beside = rank[places], _beside(rank, places, step)
    low, high = np.searchsorted(key, _key(own, -1, n)), np.searchsorted(key, _key(own, n - 1, n), "right")
    a = np.where(beside >= 0, np.searchsorted(key, _key(own, beside, n)), high)
    b = np.where(beside >= 0, np.searchsorted(key, _key(own, beside, n), "right"), high)
    count = (a - low) + (high - b)
    which = np.repeat(np.arange(len(places)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = low[which] + nth
    at += np.where(at >= a[which], (b - a)[which], 0)
    return places[which], held[at]


def matches(texts: list[list[bytes]], tests: Tests) -> tuple[np.ndarray, ...]:
    """Of one shard: (text, its first word, item, its first word, words) of each longest verbatim match of a window or more, by text.

    Equal windows are never paired with each other: distinct windows are looked up, and only
    the two ends of each match are written out. On a diagonal (text place less test place)
    left and right ends take turns, so that sorting both puts them together.
    """
    parts = [np.fromiter(map(tests.vocabulary.get, t, [0] * len(t)), np.int64, len(t)) for t in texts]
    words = np.concatenate([x for p in parts for x in (p, [0])] or [np.zeros(0, np.int64)]).astype(np.int64)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    # Only a run of words that the tests have, of a window or more, can hold a match.
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (words > 0).view(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= tests.least
    begin, end = begin[long], end[long]
    if not len(begin) or not tests.windows:
        return none
    lengths = end - begin
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(lengths + 1)[:-1])), lengths + 1) + np.arange((lengths + 1).sum())
    kept = words[at]
    kept[np.cumsum(lengths + 1) - 1] = 0
    array = suffix_array(kept, np.flatnonzero(kept), tests.most)
    found = []
    for w in tests.windows:
        low, high = _bounds(kept, array, tests.words, w)
        n = high - low
        if not n.sum():
            continue
        which = np.repeat(np.arange(len(n)), n)
        places = array[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        rank = np.full(len(kept), -1, np.int64)
        rank[places] = which
        places = np.sort(places)
        first = _ends(rank, places, -1, w.by_left, w.left_key, len(w.first))
        last = _ends(rank, places, 1, w.by_right, w.right_key, len(w.first))
        (p, s), (q, r) = ((x[o], y[o]) for x, y in (first, last) for o in [np.lexsort((x, x - y))])
        found.append((at[p], s, q - p + w.size))
    if not found:
        return none
    place, start, size = map(np.concatenate, zip(*found))
    firsts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    text = np.searchsorted(firsts, place, "right") - 1
    order = np.lexsort((start, place))
    text, place, start, size = text[order], place[order], start[order], size[order]
    return text, place - firsts[text], tests.item[start], tests.offset[start], size


def hit_words(text: np.ndarray, place: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Words of each of n texts inside any match, for matches in the order of text and place."""
    if not len(text):
        return np.zeros(n, np.int64)
    wide = int((place + size).max()) + 1
    first, last = text * wide + place, text * wide + place + size  # texts one after another on one line
    reached = np.concatenate(([0], np.maximum.accumulate(last)[:-1]))
    return np.bincount(text, np.maximum(0, last - np.maximum(first, reached)), n).astype(np.int64)


def _shards(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, own, size = 0, [], 0
    for i in range(batch.num_rows):
        text = batch.column(column)[i].as_py() or ""
        if own and size + len(text) > SHARD_BYTES:
            yield first, own
            first, own, size = i, [], 0
        own.append(words_of(text))
        size += len(text)
    if own:
        yield first, own


SHAPE = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"


def _blocks(items: DataFrame, window: int) -> Iterator[Tests]:
    """The items, each once, in blocks of about BLOCK_BYTES (or one item); one block at least."""
    items = items.distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if size <= BLOCK_BYTES else 2 * -(-size // BLOCK_BYTES)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield prepare([(r["item_id"], r["text"]) for r in own.collect()], window)


def _named(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """docs (id, text), benchmark (item_id, text) -> (id, n_words, n_hit, matches), one row for each row of docs.

    ``matches`` are the longest verbatim matches, in words, of at least ``window`` words (or
    of a whole shorter item); n_hit counts the words of the document inside any of them.
    Null and empty texts have no words; an item without words matches nothing; items that
    repeat both id and text count once, and others are told apart by item_id only. The
    benchmark is broadcast in blocks of about BLOCK_BYTES (or one item); with more than one
    block, what each finds is brought together by document. Other columns are not read.
    Empty tables give no matches, or no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), "text")
    blocks = list(_blocks(_named(benchmark), window))

    def scan(block: Tests) -> DataFrame:
        sent, several = spark.sparkContext.broadcast(block), len(blocks) > 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(sent.value.names, pa.string())
            for batch in batches:
                for first, shard in _shards(batch):
                    text, place, item, start, size = matches(shard, sent.value)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(shard)))))
                    structs = pa.StructArray.from_arrays([names.take(pa.array(item)), pa.array(place), pa.array(start), pa.array(size)], names=["item_id", "doc_word", "item_word", "n_words"])
                    rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
                    own = batch.slice(first, len(shard))
                    counts = pa.array([len(t) for t in shard], pa.int64()), pa.array(hit_words(text, place, size, len(shard)))
                    yield pa.RecordBatch.from_arrays([*own.columns[: 1 + several], *counts, rows], names=[*["id", "text"][: 1 + several], "n_words", "n_hit", "matches"])

        return in_arrow(texts, run, f"id {kind}, {'text string, ' * several}n_words bigint, n_hit bigint, matches {SHAPE}")

    if len(blocks) == 1:
        return scan(blocks[0]).withColumnRenamed("id", id_col)
    found = scan(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(scan(block))
    key = F.xxhash64("text").alias("h1"), F.sha2("text", 256).alias("h2")
    merged = (
        found.select("id", *key, "n_words", "matches")
        .groupBy("id", "h1", "h2")
        .agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"), (F.count("*") / len(blocks)).cast("int").alias("times"))
    )
    found = merged.select("id", "n_words", "matches", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["n_words"]).alias("e"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    hit = F.aggregate(
        ordered,
        zero,
        lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), m["e"] - F.greatest(m["s"], a["to"]))).alias("n"), F.greatest(a["to"], m["e"]).alias("to")),
        lambda a: a["n"],
    )
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "matches")


def contaminated() -> Column:
    """A twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated documents; all columns stay, whatever their names.

    Each row is judged by its own text, in place, so that no text is shuffled; rows with null
    and empty texts stay, and repeated rows stay or go alike. Only a benchmark of several
    blocks needs what they find brought together first: then every row of a contaminated
    doc_id goes. Empty tables take nothing, or give no rows.
    """
    blocks = _blocks(_named(benchmark), window)
    tests = next(blocks)
    if next(blocks, None) is not None:
        return without_ids(docs, find_matches(docs, benchmark, window).where(contaminated()).select("doc_id"))
    sent, at = docs.sparkSession.sparkContext.broadcast(tests), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, shard in _shards(batch, at):
                text, place, _, _, size = matches(shard, sent.value)
                hits = hit_words(text, place, size, len(shard))
                clean = (hits == 0) | (20 * hits < np.array([len(t) for t in shard]))
                yield batch.slice(first, len(shard)).filter(pa.array(clean))

    return in_arrow(docs, run, docs.schema)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of documents; nulls and repeats as in find_matches()."""
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = {
    "op2_benchmark_decontamination": r"""
with d as (
  select row_number() over () as k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bw as (
  select distinct item_id, n, w[i:i + n - 1] as g
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select k, n, p, w[p:p + n - 1] as g
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hits as (select k, p, n, item_id from dw join bw using (n, g)),
words as (select k, count(distinct q) as n_hit from (select k, unnest(range(p, p + n)) as q from (select distinct k, p, n from hits)) group by k),
items as (select k, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from hits group by k)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (k) left join items using (k)
""",
}
