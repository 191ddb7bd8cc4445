"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, in_arrow, release, table, without_ids
from .components import components

BITS = 64
#: Shingles whose bits are added up at once; bounds the memory that a long text takes.
AT_ONCE = 1 << 16
#: Fingerprints that one task writes out as 65 variants each.
FANNED = 20_000
#: A key of more rows than this and than a HOT_SHARE-th of all is hot. There are HOT_SHARE hot keys at most.
HOT_ROWS, HOT_SHARE = 256, 200


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included.

    A-Z is lower-cased and words end at ASCII white space. A text of fewer words is one
    shingle; one without words (or null) has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    total = len(words) - width + 1
    starts = np.concatenate(([0], ends[: total - 1])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, stops)), np.uint64, total)


def simhash_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + AT_ONCE])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, width: int) -> int:
    """64-bit SimHash of the shingles of ``width`` words, repeats counted."""
    return simhash_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row (id, fp long) for each row of docs; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def ball(fp: Column, radius: int) -> Column:
    """Every value that differs from fp in at most ``radius`` (0 or 1) bits."""
    if radius == 0:
        return F.array(fp)
    if radius != 1:
        raise ValueError("balls of more than one bit are not built: radius / 2 is 0 or 1")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in (1 << i for i in range(BITS))])
    return F.transform(masks, lambda m: fp.bitwiseXOR(m))


def fingerprint_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """distinct (fp long, no repeats) -> links (a, b) that connect all fingerprints within ``distance`` bits.

    Two values within 2 bits share a value that is within 1 bit of both. A value has 65
    others within 1 bit, itself included, so no bucket is larger, whatever the input. All
    of a bucket lie within 2 bits of each other; each is linked to the least, which keeps
    every component without writing out the pairs. A null fingerprint has no links.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    if distance == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    variants = distinct.where("fp is not null").select("fp", F.explode(ball(F.col("fp"), 1)).alias("variant"))
    buckets = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return (
        buckets.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a != b")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .distinct()
    ) if distance == 2 else (
        variants.where("variant != fp")
        .join(distinct.select(F.col("fp").alias("variant")), "variant", "left_semi")
        .select(F.least("fp", "variant").alias("a"), F.greatest("fp", "variant").alias("b"))
        .distinct()
    )


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """n rows, dealt to tasks of FANNED rows before each is written out as many."""
    return rows.repartition(1 + n // FANNED)


def spread_join(rows: DataFrame, of_key: DataFrame, key: str, other: str, at_once: int | None = None) -> DataFrame:
    """rows (written) joined to of_key where rows.key = of_key.other, so that no key's rows all meet in one task.

    The rows of a hot key stay where they are and the few rows of of_key that they need are
    broadcast. With ``at_once`` a task has about so many rows, as where of_key holds long arrays.
    """
    n, same = rows.count(), F.col(key) == F.col(other)
    hot = F.count("*") > max(HOT_ROWS, n // HOT_SHARE)
    often = [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).agg(hot.alias("hot")).where("hot").collect()]
    parts = lambda some: some.repartition(1 + n // at_once, key) if at_once else some
    if not often:
        return parts(rows).join(of_key, same)
    near = rows.where(F.col(key).isin(often)).join(F.broadcast(of_key.where(F.col(other).isin(often))), same)
    return near.unionByName(parts(rows.where(~F.col(key).isin(often))).join(of_key.where(~F.col(other).isin(often)), same))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """docs -> (id, fp long, component): the least id that links of ``distance`` bits reach, itself included.

    Exact copies share a fingerprint, so groups are found between distinct fingerprints;
    a group of copies costs one fingerprint, however large it is. Null and empty texts
    have fingerprint 0 and are linked like any other. Rows with a null id keep their
    fingerprint and get the component of its group (null where all ids are null);
    repeated rows are returned as often as they come; an empty table gives no rows; columns
    other than the two are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    least = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(fingerprint_links(dealt(least.select("fp"), least.count()), distance))
    held = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = held.groupBy("root").agg(F.min("least").alias("component"))
    named = held.join(of_root, "root").select(F.col("fp").alias("_fp"), "component")
    return spread_join(prints, named, "fp", "_fp").select("id", "fp", "component")


#: Consistent samples of a text's shingles that get a SimHash of their own, and the shingles of a sample.
SAMPLES, SAMPLE_SIZE = 16, 4
#: Bits of the filter of wanted texts for each of them, and the most bits; others that pass it are dropped by a join.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Counters of shingles by hash; they only order the shingles of a text, the rare ones first.
SLOTS = 1 << 18
#: Parity bits of a text's distinct shingles: two texts differ in at least as many shingles as bits.
PARITY = 1_024
#: Rows of signatures that a worker holds.
ROWS_AT_ONCE = 1_024
#: Pairs, each with its sets of shingles, that one task compares.
PAIRS_AT_ONCE = 2_000
#: Sets of shingles that are sorted at once.
SETS_AT_ONCE = 128
_TURNS = np.array([int.from_bytes(xxhash.xxh64_digest(b"sample", i), "little") | 1 for i in range(SAMPLES)], np.uint64)


def sample_prints(distinct: np.ndarray) -> np.ndarray:
    """SimHash of each sample: the SAMPLE_SIZE least of the distinct hashes under each of SAMPLES multipliers."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    least = np.full((SAMPLES, SAMPLE_SIZE), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), AT_ONCE // SAMPLES):
        turned = distinct[None, at : at + AT_ONCE // SAMPLES] * _TURNS[:, None]
        every = np.concatenate((least, turned), axis=1)
        least = np.partition(every, SAMPLE_SIZE - 1, axis=1)[:, :SAMPLE_SIZE]
    own = np.minimum(SAMPLE_SIZE, len(distinct))
    least = np.sort(least, axis=1)[:, :own]
    bits = np.unpackbits(np.ascontiguousarray(least).view(np.uint8).reshape(SAMPLES, own, 8), axis=2, bitorder="little")
    found = np.packbits(2 * bits.sum(axis=1) > own, axis=1, bitorder="little").view("<u8").ravel()
    return found ^ (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_hash(text: str | None) -> int:
    """XXH64 of all words, joined by spaces; A-Z is lower-cased."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 7)


def _lists(x: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x])))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, words: hash of all words, fp, samples array<long>, n: distinct shingles) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
            whole, fps, samples, n = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                hashes = shingle_hashes(text, width)
                distinct = np.unique(hashes)
                whole.append(words_hash(text))
                fps.append(simhash_of(hashes))
                samples.append(sample_prints(distinct).view(np.int64))
                n.append(len(distinct))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(whole), longs(fps), _lists(samples), pa.array(n, pa.int64())], names=["id", "words", "fp", "samples", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(texts, run, f"id {kind}, words long, fp long, samples array<long>, n long")


def shingle_sets(docs: DataFrame, asked: DataFrame, text_col: str, width: int) -> DataFrame:
    """(words, shingles: all distinct hashes, parity array<long>) for each of asked (words, no repeats).

    A bit filter keeps most other texts from being hashed and shuffled; the join decides.
    """
    bits = min(MOST_BITS, max(BITS, 1 << (BITS_EACH * asked.count()).bit_length()))
    slot = F.col("words").bitwiseAND(F.lit(bits - 1))
    marks = asked.groupBy((slot / BITS).cast("long").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(words & {BITS - 1} as int))")).alias("marks")).toArrow()
    wanted = np.zeros(bits // BITS, np.uint64)
    wanted[marks["at"].to_numpy()] = marks["marks"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
            whole, sets, parity = [], [], []
            for value in batch.column(0):
                text = value.as_py()
                words = words_hash(text)
                at = words & (bits - 1)
                if int(sent.value[at // BITS]) >> (at % BITS) & 1:
                    whole.append(words)
                    distinct = np.unique(shingle_hashes(text, width))
                    sets.append(distinct.view(np.int64))
                    odd = np.bincount((distinct % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                    parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(whole, np.uint64).view(np.int64)), _lists(sets), _lists(parity)], names=["words", "shingles", "parity"])

    every = in_arrow(docs.select(F.col(text_col).alias("text")), run, "words long, shingles array<long>, parity array<long>")
    # Copies are put together before the shuffle: grouping by all columns keeps one row of each in every task.
    return every.groupBy("words", "shingles", "parity").agg(F.lit(1).alias("_")).drop("_").join(asked, "words", "left_semi")


def likeness(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two sets without repeats; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def most_alike(n: Column, parity: Column, n_b: Column, parity_b: Column) -> Column:
    """Bound of likeness() from sizes and parity bits: never less than it."""
    apart = sum((F.bit_count(F.get(parity, F.lit(i)).bitwiseXOR(F.get(parity_b, F.lit(i)))) for i in range(PARITY // BITS)), F.lit(0))
    both = (n + n_b - apart) / 2
    return F.coalesce(F.try_divide(both, n + n_b - both), F.lit(1.0))


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (words, root, shingles) -> (token, words, root, n, pos, short): the rarest shingles of each text.

    Of two texts as similar as asked, the larger one's first n - ceil(s n) + 1 shingles and
    the smaller one's first n - ceil(2 s / (1 + s) n) + 1 (``short``) have one in common, in
    any order that all texts share. Here that is by how often a shingle comes, so that what
    many texts have in common brings none of them together.
    """
    slots = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).count().toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["count"].to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    least = lambda n, share: n - np.ceil(share * n - 1e-6).astype(np.int64) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, SETS_AT_ONCE) for b in batches for a in range(0, b.num_rows, SETS_AT_ONCE)):
            own = batch.column(2)
            flat = own.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(own.offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, sent.value[flat & (SLOTS - 1)], row))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            kept = pos < least(n, similarity)[row]
            row, pos, token = row[kept], pos[kept], flat[order][kept]
            short = pos < least(n, 2 * similarity / (1 + similarity))[row]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), batch.column(0).take(at), batch.column(1).take(at), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(short)],
                names=["token", "words", "root", "n", "pos", "short"],
            )

    return in_arrow(sets.select("words", "root", "shingles"), run, "token long, words long, root long, n int, pos int, short boolean")


def apart(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (words, root, shingles, parity) -> pairs (a, b) of different roots that may have the similarity: all that do are among them."""
    tokens = cut(prefixes(sets, similarity))
    other = tokens.where("short").select(*[F.col(c).alias(f"{c}_b") for c in tokens.columns])
    c = F.col
    larger = (c("n") > c("n_b")) | ((c("n") == c("n_b")) & (c("words") > c("words_b")))
    most = 1 + F.least(c("n") - c("pos"), c("n_b") - c("pos_b")) - 1  # shingles in common, if this is the first
    able = most * (1 + similarity) + 1e-6 >= similarity * (c("n") + c("n_b"))
    met = tokens.join(other, (c("token") == c("token_b")) & (c("root") != c("root_b")) & larger & able)
    pairs = cut(met.select(c("words").alias("a"), c("words_b").alias("b")).distinct())
    side = lambda s: sets.select(c("words").alias("_w"), F.size("shingles").alias(f"_n{s}"), c("parity").alias(f"_p{s}"))
    one = cut(spread_join(pairs, side("a"), "a", "_w").drop("_w"))
    bound = most_alike(c("_na"), c("_pa"), c("_nb"), c("_pb"))
    found = cut(spread_join(one, side("b"), "b", "_w").where(bound >= similarity).select("a", "b"))
    release(tokens, pairs, one)
    return found


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, hubs: bool = False) -> DataFrame:
    """The pairs (a, b; written) whose sets of shingles have the similarity. Only with ``hubs`` may an a be in many pairs."""
    side = lambda s: sets.select(F.col("words").alias("_w"), F.col("shingles").alias(f"_{s}"))
    one = spread_join(pairs, side("b"), "b", "_w", PAIRS_AT_ONCE).drop("_w")
    if hubs:
        one = cut(one)
        both = spread_join(one, side("a"), "a", "_w", PAIRS_AT_ONCE)
    else:
        both = one.repartition(1 + pairs.count() // PAIRS_AT_ONCE, "a").join(side("a"), F.col("a") == F.col("_w"))
    found = cut(both.where(likeness(F.col("_a"), F.col("_b")) >= similarity).select("a", "b"))
    release(one)
    return found


def _apart_in_keys(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(words, root) of the members of keys that hold several groups."""
    joined = cut(members.join(roots, F.col("words") == F.col("node"), "left").select("key", "words", F.coalesce("root", "words").alias("root")))
    mixed = joined.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select(F.col("key").alias("_key"))
    found = cut(spread_join(joined, mixed, "key", "_key").select("words", "root").distinct())
    release(joined)
    return found


def buckets(texts: DataFrame) -> DataFrame:
    """texts (words, fp, samples, n; written, words without repeats) -> (key, words, n, size) for keys that several texts share.

    A key is a sample's SimHash, or a value within one bit of the fingerprint; size is the number of its texts.
    """
    prints = cut(texts.select("fp").distinct())
    balls = dealt(prints, prints.count()).select("fp", F.explode(ball(F.col("fp"), 1)).alias("key"))
    near = balls.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    keys = near.select("key", F.explode("fps").alias("_fp")).union(prints.select("fp", "fp")).distinct()
    of_ball = spread_join(texts.select("words", "n", "fp"), keys, "fp", "_fp").select("key", "words", "n")
    every = cut(texts.select(F.explode("samples").alias("key"), "words", "n").union(of_ball).distinct())
    shared_keys = every.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("size")).where("size > 1")
    found = cut(spread_join(every, shared_keys, "key", "_key").select("key", "words", "n", "size"))
    release(prints, every)
    return found


def classes(docs: DataFrame, rows: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """docs and their signatures -> (words, component) for each distinct text: the least id of its group."""
    texts = cut(rows.groupBy("words", "fp", "samples", "n").agg(F.min("id").alias("least")))
    members = buckets(texts)
    sets = cut(shingle_sets(docs, members.select("words").distinct(), text_col, width))
    fits = lambda x, y: (x == y) | (F.least(x, y) / F.greatest(x, y) >= similarity)
    # The original of edited copies shares its keys with most of them, so it leads them all.
    rank = members.groupBy(F.col("words").alias("_w")).agg((-F.sum("size")).alias("rank"))
    ranked = cut(members.join(rank, F.col("words") == F.col("_w")).select("key", "words", "n", "rank"))
    heads = ranked.groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("rank", "words", "n")).alias("head"))
    led = spread_join(ranked, heads, "key", "_key").where((F.col("words") != F.col("head.words")) & fits(F.col("n"), F.col("head.n")))
    pairs = cut(led.select(F.col("words").alias("a"), F.col("head.words").alias("b")).distinct())
    roots = cut(components(_alike(pairs, sets, similarity)))
    still = _apart_in_keys(ranked, roots)
    release(members, ranked, pairs)
    forget(docs.sparkSession)
    pairs = apart(sets.join(still.select(F.col("words").alias("_w"), "root"), F.col("words") == F.col("_w")).drop("_w"), similarity)
    linked = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_alike(pairs, sets, similarity, hubs=True))
    roots = cut(components(linked))
    held = texts.join(roots, F.col("words") == F.col("node"), "left").select("words", "least", F.coalesce("root", "words").alias("root"))
    of_root = held.groupBy("root").agg(F.min("least").alias("component"))
    found = cut(held.join(of_root, "root").select("words", "component"))
    release(texts, sets, still, pairs, roots)
    forget(docs.sparkSession)
    return found


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs -> (id, component): the least id of its group of copies and near copies, itself included.

    Texts of the same words are copies. Two texts are candidates if their fingerprints lie
    within 2 bits (ball hashing), or if a sample of theirs has the same SimHash; balls alone
    find only texts that are almost equal, as a similarity of 0.8 comes to some 10 bits.
    Candidates link if the exact Jaccard similarity of all their distinct shingles is
    ``similarity`` or more. Every text of a bucket first meets the one that shares buckets
    with most texts, as the original of edited copies does; this joins most groups by pairs
    that grow with the rows. Then all texts of buckets that still hold several groups
    meet those that share a rare shingle with them (see prefixes()), which leaves out no
    pair that has the similarity. Null and empty texts are copies of each other; repeated
    rows, null ids, empty tables and other columns are as in simhash_groups().
    """
    rows = cut(signatures(docs, id_col, text_col, width))
    group = classes(docs, rows, text_col, width, similarity).select(F.col("words").alias("_words"), "component")
    return spread_join(rows, group, "words", "_words").select("id", "component")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the documents whose group has a smaller doc_id; all columns stay.

    Rows that repeat the least doc_id of a group are one document and stay together; rows
    with a null id go unless no row of some group has an id. Groups are those of
    similar_groups(). Columns that docs has besides doc_id and text may have any name. An
    empty table gives no rows.
    """
    least = classes(docs, signatures(docs, "doc_id", "text", width), "text", width, similarity).select("component").distinct()
    gone = docs.select(F.col("doc_id").alias("_id")).distinct().join(least, F.col("_id").eqNullSafe(F.col("component")), "left_anti")
    return without_ids(docs, gone)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of documents; nulls, copies and repeats as in simhash_groups()."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
