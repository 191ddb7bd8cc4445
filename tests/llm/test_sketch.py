import hashlib
import re

from pyspark.sql import functions as F

from lectern.llm import sketch


def sketches(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["s"] for r in sketch.with_sketch(df, "text", "s", **how).orderBy("i").collect()]


def shingles(text):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_all_hashes_give_the_exact_similarity(spark):
    a, b = "a b c d e f g h", "b c d e f g h i j"
    x, y = map(set, sketches(spark, [a, b], scale_bits=0))
    assert len(x & y) / len(x | y) == len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_the_fraction_is_fixed_and_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"b{i}" for i in range(40))
    whole, part, full = sketches(spark, [a, b, a], scale_bits=3)
    assert whole == full and 300 < len(whole) < 460 and all(0 <= h < 1 << 61 for h in whole)
    df = spark.createDataFrame([(whole, part)], "a array<long>, b array<long>")
    assert df.select(sketch.merged("a", "b", 3)).first()[0] == sorted(h for h in {*whole, *part} if 0 <= h < 1 << 61)


def test_short_empty_and_null_texts(spark):
    none, empty, blank, one, same, other = sketches(spark, [None, "", " \t\n", "x", " X ", "y"])
    assert none == empty == blank == [] and one == same and len(one) == len(other) == 1 and one != other


def test_likeness_and_containment(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([], []), ([1], [])], "a array<long>, b array<long>")
    got = [tuple(r) for r in df.select(sketch.likeness("a", "b"), sketch.containment("a", "b")).collect()]
    assert got == [(0.5, 1.0), (1.0, 1.0), (0.0, 0.0)]


def test_neighbours_close_a_ring_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_ROWS", 1)
    ids = [5, 9, -3, 1000, 42, 43, 44, 7_000_000_000, None, 0]
    found = {r["doc_id"]: (r["before_id"], r["before_need"]) for r in sketch.neighbours(spark.createDataFrame([(i, (i or 0) % 10) for i in ids], "doc_id bigint, need bigint")).collect()}
    down = sorted((i for i in ids if i is not None), reverse=True) + [None]
    assert found == {i: (down[k - 1], (down[k - 1] or 0) % 10) for k, i in enumerate(down)}


def test_edited_texts_equal_the_plain_version(spark, documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    rows.sort(reverse=True)
    got = {r["doc_id"]: r for r in sketch.edit_study(documents.where("doc_id is not null")).collect()}
    for k, (i, text) in enumerate(rows):
        n, after = len(text) // 3, rows[(k + 1) % len(rows)][1]
        assert (got[i]["n_chars"], got[i]["edited"]) == (len(text), text[: len(text) - n] + after[:n])


def test_query(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sketch.op3_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == documents.count()
    by = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by.setdefault(r["doc_id"], r["fingerprint"])
    assert by[1] == by[121] and by[1] != by[4]  # the texts of ids 1 and 121 are copies
    one = spark.createDataFrame([(8, "abc def")], "doc_id bigint, text string")
    only = sketch.edit_study(one).select("edited", sketch.likeness("sketch", "next_sketch").alias("near"), F.sha2("edited", 256).alias("h")).first()
    assert only["edited"] == "abc dab" and only["near"] == 1.0 and only["h"] == hashlib.sha256(b"abc dab").hexdigest()


def test_empty_table(spark, empty):
    assert sketch.edit_study(empty).count() == 0


def plain_sketch(text, scale_bits, h):
    kept = {x for x in map(h, shingles(text)) if x & (1 << 64) - 1 < 1 << 64 - scale_bits}
    own = {h(x) for x in shingles(text)}
    return kept or ({min(own)} if own else set())


def test_sketches_and_likenesses_equal_plain_sets(spark, documents):
    """Every retained hash is the chained XXH64 of a shingle's words, and every likeness that of the sets."""
    rows = [r["text"] for r in documents.collect() if len(r["text"] or "") < 2000]
    words = sorted({w for t in rows for s in shingles(t) for w in s})
    grams = sorted({s for t in rows for s in shingles(t)})
    of_word = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    chained = lambda s: "aggregate(array(" + ", ".join(f"{of_word[w]}L" for w in s) + "), 42L, (s, x) -> xxhash64(s, x))"
    five = [s for s in grams if len(s) == 5]
    frame = spark.createDataFrame([(list(s), [of_word[w] for w in s]) for s in five], "s array<string>, h array<long>")
    known = {tuple(r["s"]): r["x"] for r in frame.select("s", F.expr("xxhash64(h[0], h[1], h[2], h[3], h[4])").alias("x")).collect()}
    known |= {s: spark.range(1).select(F.expr(chained(s))).first()[0] for s in grams if len(s) < 5}
    df = spark.createDataFrame([(i, t, t[: len(t) // 2] + " more" if t else None) for i, t in enumerate(rows)], "i int, text string, part string")
    both = sketch.with_sketch(sketch.with_sketch(df, "text", "a"), "part", "b")
    got = both.select("i", "a", sketch.likeness("a", "a").alias("same"), "b", sketch.likeness("a", "b").alias("near"), sketch.containment("b", "a").alias("held")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_sketch(rows[r["i"]], sketch.SCALE_BITS, known.__getitem__)
        assert r["a"] == sorted(want)
        b = set(r["b"])
        assert r["near"] == (len(want & b) / len(want | b) if want | b else 1.0) and r["held"] == (len(want & b) / len(b) if b else 1.0) and r["same"] == 1.0


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([("a b c", 1, 2, 3, "x", "y", "z")], "text string, _h int, _s int, _k int, hashes string, shingles string, kept string")
    out = sketch.with_sketch(df, "text", "sketch")
    assert out.columns == [*df.columns, "sketch"] and out.drop("sketch").first() == df.first()
