import random

import numpy as np
import xxhash

from lectern.llm import simhash as S
from lectern.llm.components import components


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark, documents):
    for width in (1, 3, 5):
        rows = S.fingerprints(documents, width=width).join(documents.select(documents["doc_id"].alias("id"), "text"), "id").collect()
        assert rows and all(r["fp"] & (1 << 64) - 1 == plain_fingerprint(r["text"], width) for r in rows if len(r["text"] or "") < 9999)


def test_long_texts_are_added_up_in_parts(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = S.fingerprint_of(text, 3)
    monkeypatch.setattr(S, "AT_ONCE", 7)
    assert S.fingerprint_of(text, 3) == whole == plain_fingerprint(text, 3)


def test_links_lose_no_component(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:10]:  # chains and balls of one and two flips
        x = b
        for _ in range(6):
            x ^= 1 << rnd.randrange(64)
            x ^= (1 << rnd.randrange(64)) * rnd.randrange(2)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for distance in (1, 2):
        links = S.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).collect()
        close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
        assert groups([(r["a"], r["b"]) for r in links], signed) == groups(close, signed)
        assert {(min(r), max(r)) for r in links} <= set(close)


def test_simhash_groups_equal_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"], 3) if len(r["text"] or "") < 9999 else S.fingerprint_of(r["text"], 3) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    of = groups(links, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[of[i]] = min(least.get(of[i], r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), least[of[i]]) for i, r in enumerate(rows))
    got = S.simhash_groups(documents).collect()
    assert sorted((str(r["id"]), r["component"]) for r in got) == want


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(4)
    path = list(range(100, 160))
    rnd.shuffle(path)
    links = list(zip(path, path[1:])) + [(7, i) for i in range(8, 60)] + [(1, 1), (2, 3), (3, 2)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 5)], "a long, b long")).collect()}
    assert found == {n: r for n, r in groups(links, {x for e in links for x in e}).items() if n != 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(words, n, rnd):
    own = list(words)
    for i in rnd.sample(range(len(own)), n):
        own[i] = f"new{rnd.random()}"
    return " ".join(own)


def test_keep_one_takes_copies_and_near_copies_and_leaves_the_rest(spark):
    rnd = random.Random(6)
    texts = [[f"w{rnd.randrange(5000)}" for _ in range(300)] for _ in range(20)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, near(t, 5, rnd)) for i, t in enumerate(texts[:10])] + [(200 + i, " ".join(t).upper()) for i, t in enumerate(texts[:10])]
    rows += [(300 + i, " ".join(t[:90]) + " " + passage) for i, t in enumerate(texts[10:])]
    rows += [(400, None), (401, ""), (402, "short one"), (403, "short two"), (0, rows[0][1])]
    kept = sorted(r["doc_id"] for r in S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept == sorted([0, *range(20), *range(300, 310), 400, 402, 403])


def test_likeness_is_exact(spark):
    rows = [([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), (list(range(400)), list(range(100, 500)))]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<int>, b array<int>").select(S.likeness(S.F.col("a"), S.F.col("b"))).collect()]
    assert np.allclose(got, [0.5, 1, 0, 0.6])


def exact_groups(texts, width=5, similarity=0.8):
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (t.split() for t in texts)]
    alike = [(i, j) for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) / len(a | sets[j]) >= similarity]
    return groups(alike, range(len(texts)))


def spread(words, n, at, mark):
    """n words replaced, so far apart that each takes its own five shingles."""
    own = list(words)
    for k in range(n):
        own[at + 10 * k] = f"{mark}x{k}"
    return " ".join(own)


def test_edited_copies_meet_their_original_of_the_greatest_id(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(600)]
    texts = [near(words, 9, rnd) for _ in range(60)] + [" ".join(words)]
    want = exact_groups(texts)
    assert set(want.values()) == {0} and len(set(exact_groups(texts[:-1]).values())) > 30
    got = S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["id"]: r["component"] for r in got} == want


def test_long_texts_are_decided_on_all_shingles(spark):
    texts = []
    for k in range(12):  # 1,996 shingles: 0.801 with 44 words replaced, 0.797 with 45
        words = [f"t{k}w{i}" for i in range(2000)]
        texts += [" ".join(words), spread(words, 44 + k % 2, 20, "new")]
    want = exact_groups(texts)
    assert len(set(want.values())) == 18
    got = S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["id"]: r["component"] for r in got} == want


def test_bound_of_likeness_is_never_less(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(near(words[:n], n // e, rnd),) for n in (6, 40, 300, 900) for e in (4, 9, 30, 90) for _ in range(2)], "text string")
    asked = S.signatures(docs.selectExpr("1 as doc_id", "text"), "doc_id", "text", 5).select("words").distinct()
    a = S.shingle_sets(docs, asked, "text", 5)
    b = a.toDF("words_b", "shingles_b", "parity_b")
    c = S.F.col
    bound = S.most_alike(S.F.size("shingles"), c("parity"), S.F.size("shingles_b"), c("parity_b"))
    rows = a.crossJoin(b).select(S.likeness(c("shingles"), c("shingles_b")), bound).collect()
    assert len(rows) == asked.count() ** 2 and all(x <= y <= 1 for x, y in rows) and any(y < 0.8 for _, y in rows)


def test_empty_table(spark, empty):
    assert S.simhash_groups(empty).count() == 0
    assert S.keep_one(empty).count() == 0


def test_recall_against_all_pairs_and_clashing_columns(spark):
    """Groups of copies edited to all degrees: at least 0.9 of the pairs of 0.8 end in one group, and no other texts do."""
    rnd = random.Random(10)
    texts = []
    for k in range(8):
        words = [f"g{k}w{rnd.randrange(4000)}" for _ in range(rnd.choice([40, 150, 500]))]
        texts += [" ".join(words)] + [near(words, rnd.randint(0, len(words) // 12), rnd) for _ in range(20)]
    want = exact_groups(texts)
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], "doc_id bigint, text string, _id int, words string, key int")
    got = {r["id"]: r["component"] for r in S.similar_groups(docs).collect()}
    together = [(i, j) for i in want for j in range(i) if want[i] == want[j]]
    found = sum(got[i] == got[j] for i, j in together)
    assert len(together) > 100 and found >= 0.9 * len(together)
    assert all(want[i] == want[j] for i in got for j in range(i) if got[i] == got[j])
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())
