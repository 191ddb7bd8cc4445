import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import langid

PARTS = {"en": ["the", "and", "ther", "ing", "ould"], "fr": ["le", "eau", "ou", "é", "que"], "de": ["sch", "ich", "und", "ü", "ß"]}


def texts(n, seed):
    rnd = random.Random(seed)
    return [(" ".join("".join(rnd.choice(PARTS[g]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(3, 60))), g) for g in PARTS for _ in range(n)]


def test_held_out_accuracy():
    model = langid.fit(texts(40, 1))
    test = texts(60, 2)
    langs, scores = langid.predict([t for t, _ in test], model)
    assert sum(a == b for a, (_, b) in zip(langs, test)) >= 0.98 * len(test)
    assert ((0 <= scores) & (scores <= 1)).all()


def test_kernel_equals_the_plain_version():
    model = langid.fit(texts(10, 3))
    a, b = texts(1, 4)[0][0], texts(1, 5)[1][0]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    plain = lambda t: grams(" " + " ".join(t.split()) + " ")
    own = lambda t: set(langid.grams(t, model.code, model.size).tolist())
    assert (len(own(a)), len(own(b)), len(own(a) & own(b))) == (len(plain(a)), len(plain(b)), len(plain(a) & plain(b)))


def test_model_is_the_same_for_any_order():
    rows = texts(20, 6)
    one, two = langid.fit(rows), langid.fit(rows[::-1] + rows[:5])
    assert one.langs == two.langs and np.allclose(one.weights, two.weights)


def test_texts_without_letters_are_unknown():
    model = langid.fit(texts(5, 7))
    langs, scores = langid.predict(["", "123 !?", " \n", "🙂 ²½Ⅷ", "ж", "a", "² a"], model)
    assert langs[:4] == ["und"] * 4 and scores[:4].tolist() == [0] * 4 and "und" not in langs[4:]
    assert langid.fit([]) is None and langid.predict(["abc"], None)[0] == ["und"]


def test_long_texts_are_read_whole():
    model = langid.fit(texts(20, 8))
    long = " ".join(t for t, g in texts(30, 9) if g == "en")[:200] + " " + " ".join(t for t, g in texts(400, 10) if g == "de")
    assert langid.predict([long], model)[0] == ["de"]


def test_query_learns_only_from_its_part(spark, tmp_path):
    rows = [(i, t, g) for i, (t, g) in enumerate(texts(60, 11))]
    df = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "", "fr"), (None, "the and", "en")], "doc_id bigint, text string, lang string")
    # wrong labels on held-out rows change nothing
    spoilt = df.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    spoilt.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op6_language_id(spark, str(tmp_path)).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert {r["lang_pred"] for r in got.values()} == {"en", "fr", "de", "und"}
    out = [i for i, _, _ in rows if got[i]["held_out"]]
    assert len(out) > 20 and sum(got[i]["lang_pred"] == rows[i][2] for i in out) >= 0.95 * len(out)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PER_LANG", 7)
    rows = [(i, t, g) for i, (t, g) in enumerate(texts(60, 12))]
    found = langid.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert found and all(sum(g == x for _, g in found) <= 7 for x in PARTS)


def test_stage_and_empty_table(spark, empty):
    assert langid.identify(empty, langid.trained(empty)).count() == 0
    df = spark.createDataFrame([(1, "the and thering", "en"), (2, "12", "en"), (3, None, "en"), (4, "le eau", "fr"), (None, "the", "en")], "doc_id bigint, text string, lang string")
    kept = langid.known_language(df, langid.fit(texts(5, 13)))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "None"]


def test_stage_without_labels_keeps_lettered_documents(spark, documents):
    docs = documents.withColumn("lang", F.lit(None).cast("string"))
    model = langid.trained(docs)
    kept = [r["text"] for r in langid.known_language(docs, model).collect()]
    assert model is None and sorted(kept) == sorted(r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_scores_equal_plain_kernel_ridge_regression():
    rows = texts(8, 20)
    model = langid.fit(rows)
    rows = sorted(set(rows), key=lambda r: (r[1], r[0]))
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in (" " + " ".join(t.split()) + " " for t, _ in rows)]
    test = texts(4, 21)
    own = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in (" " + " ".join(t.split()) + " " for t, _ in test)]
    kernel = lambda x, y: np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in y] for a in x])
    # All rows are landmarks here, so that the plain dual solution with weights must come out.
    target = np.array([[float(g == r[1]) for g in model.langs] for r in rows])
    weight = 1 / target.sum(0)[[model.langs.index(r[1]) for r in rows]]
    dual = np.linalg.solve(kernel(grams, grams) + langid.RIDGE * np.diag(1 / weight), target)
    want = kernel(own, grams) @ dual
    langs, scores = langid.predict([t for t, _ in test], model)
    assert langs == [model.langs[k] for k in want.argmax(1)]
    assert np.allclose(scores, np.clip(want.max(1), 0, 1), atol=1e-3)


def test_every_language_is_learned_however_many_and_long(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 90 * 1500)
    rnd = random.Random(22)
    own = {f"l{k:02}": [chr(0x4E00 + 40 * k + i) for i in range(40)] for k in range(90)}  # as many scripts, 3,600 letters
    made = lambda g, n: "".join(rnd.choice(own[g]) for _ in range(n))
    rows = [(g, made(g, 5000)) for g in own for _ in range(3 if g < "l45" else 12)] + [(g, made(g, 900)) for g in own if g > "l10"]
    docs = spark.createDataFrame([(3 * i, t, g) for i, (g, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    docs = docs.where(~langid.held_out())
    found = langid.sample(docs)
    learned = {g for _, g in found}
    assert learned == {r[0] for r in docs.select("lang").distinct().collect()} and len(learned) > 64
    model = langid.fit(found)
    test = [(made(g, 60), g) for g in sorted(learned)]
    assert [g for _, g in test] == langid.predict([t for t, _ in test], model)[0]


def test_a_wrong_language_goes_and_nothing_is_shuffled(spark):
    model = langid.fit(texts(20, 23))
    rows = [(i, t, g, 1, "x") for i, (t, g) in enumerate(texts(5, 24))] + [(90, "Ωμέγα και άλφα", None, 2, "x"), (91, "日本語の文章", None, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _id int, lang_pred string")
    stage = langid.known_language(docs, model, ("en", "fr"))
    assert sorted(r["doc_id"] for r in stage.collect()) == [i for i, _, g, *_ in rows if g in ("en", "fr")]
    assert sorted(r["doc_id"] for r in langid.known_language(docs, model).collect()) == list(range(15))
    assert stage.columns == docs.columns and "Exchange" not in stage._jdf.queryExecution().toString()
