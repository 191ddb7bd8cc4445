import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import top_k
from lectern.operators import answers, evaluation, labels, navigation, passages, quality, retrieval, store
from lectern.plans import queries


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_filter_comes_before_the_cut(spark):
    index = [(i, [1.0, float(i)], "exercise" if i < 70 else "content") for i in range(73)]
    nodes = spark.createDataFrame(index, "id bigint, embedding array<float>, kind string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, embedding array<float>")
    assert rows(retrieval.search(asked, nodes, k=30), "id", "rank") == [(70, 1), (71, 2), (72, 3)]


def test_top_k_ties_nulls_and_zero_vectors(spark):
    nodes = spark.createDataFrame([(3, [2.0, 0.0]), (1, [1.0, 0.0]), (2, None), (4, [0.0, 0.0])], "id bigint, embedding array<float>")
    asked = spark.createDataFrame([("q", [5.0, 0.0]), ("n", None)], "qid string, embedding array<float>")
    assert rows(top_k(asked, nodes, 9), "qid", "id", "rank", "score") == [("q", 1, 1, 1.0), ("q", 3, 2, 1.0), ("q", 4, 3, 0.0)]
    assert top_k(asked.limit(0), nodes, 9).count() == 0 and top_k(asked, nodes.limit(0), 9).count() == 0


def test_figure_links_and_neighbours(spark):
    p = spark.createDataFrame([("b", 1, "p1", ["s"], "see Fig. 3–2 and figura 7"), ("b", 2, "p2", ["s"], "x " * 130), ("b", 3, "p3", ["t"], None)], "book_id string, ord int, id string, section_path array<string>, text string")
    f = spark.createDataFrame([("b", "f1", "3-2", 1), ("b", "f2", "7", 2), ("c", "f3", "7", 1)], "book_id string, id string, identifier string, ord int")
    assert rows(retrieval.figure_links(p, f), "id", "figure_id") == [("p1", "f1"), ("p1", "f2")]
    assert rows(retrieval.neighbours(p), "id", "before", "after") == [("p1", None, "p2"), ("p2", "p1", None), ("p3", None, None)]
    near = retrieval.neighbour_texts(p.select("id").limit(1), p).first()
    assert near["truncated"] and len(near["text"].split()) == 120


def test_figure_budget(spark):
    direct = spark.createDataFrame([("q", f"d{i}", i, 1 - i / 10) for i in range(1, 6)], "qid string, id string, rank int, score double")
    linked = spark.createDataFrame([("q", "l1", 1, 0, 0.9), ("q", "d1", 1, 1, 0.9), ("q", "l2", 2, 0, 0.8)], "qid string, id string, passage_rank int, pos int, score double")
    assert rows(retrieval.figure_budget(direct, linked), "position", "id", "score") == [(1, "d1", 0.9), (2, "d2", 0.8), (3, "l1", 0.9), (4, "l2", 0.8)]


def test_group_evidence(spark):
    data = [("q", "a", 1, 0.5, True, "English"), ("q", "b", 2, 0.9, True, "es"), ("q", "a", 3, None, True, "x"), ("q", "b", 4, 0.95, False, "es"), ("q", "c", 5, 0.9, None, "es"), ("q", "a", 6, 0.7, True, "en")]
    got = retrieval.group_evidence(spark.createDataFrame(data, "qid string, book_id string, rank int, score double, flag boolean, language string"))
    assert rows(got, "number", "rank", "translation_available") == [(1, 2, True), (2, 6, False), (3, 1, False), (4, 3, True)]


PAGE = "struct<pdf:int,pdf_from:int,pdf_to:int,text:string>"


def test_hits_and_scores(spark):
    schema = f"id string, status string, expect_not_found boolean, evidence array<struct<book:string,work:string,state:string,pages:array<{PAGE}>>>"
    ok = lambda *pages, state="confirmed", book="a", work="w": (book, work, state, [(p if isinstance(p, int) else None, *((None, None) if isinstance(p, int) else p), "ok") for p in pages])
    records = spark.createDataFrame([("q1", "confirmed", False, [ok(5, (7, 9)), ok(2, book="b", work="v")]), ("q2", "draft", False, [ok(1)]), ("q3", "confirmed", True, [ok(1)]), ("q4", "confirmed", False, [ok(1, state="open")])], schema)
    evidence = evaluation.scoreable(records, spark.createDataFrame([("a",), ("b",)], "book string"))
    assert rows(evidence, "qid", "book", "page") == [("q1", "a", p) for p in (5, 7, 8, 9)] + [("q1", "b", 2)]
    results = spark.createDataFrame([("q1", 1, "a", 6, 6), ("q1", 2, "a", 9, 12), ("q1", 11, "b", 1, 2)], "qid string, rank int, book string, pdf_start int, pdf_end int")
    scores = evaluation.score_questions(evaluation.mark_hits(results, evidence), evidence).first()
    assert (scores["hit5"], scores["first_hit_rank"], scores["works"], scores["works_covered10"]) == (True, 2, 2, 1)


@pytest.mark.parametrize("before, after, passed", [("11", "11", True), ("10", "01", True), ("11", "10", False), ("00", "01", True), ("10", "00", False)])
def test_run_gate(spark, before, after, passed):
    run = lambda bits: spark.createDataFrame([(i, True, b == "1") for i, b in enumerate(bits)] + [(99, False, True)], "qid int, scored boolean, hit5 boolean")
    assert evaluation.run_gate(run(before), run(after)).first()["passed"] == passed
    lost = {i for i, (a, b) in enumerate(zip(before, after)) if a > b}
    assert {r["qid"] for r in evaluation.compare_runs(run(before), run(after)).where("change = 'lost'").collect()} == lost


def test_served_totals(spark):
    logged = spark.createDataFrame([("a", 1, "x", 1, 1, True, True), ("a", 2, "x", 9, 9, None, True), ("b", 1, "x", 1, 1, None, True), ("c", 1, "x", 1, 1, False, False)], "qid string, rank int, book string, pdf_start int, pdf_end int, grade boolean, in_scope boolean")
    evidence = spark.createDataFrame([("a", "x", 1, "w"), ("b", "x", 1, "w")], "qid string, book string, page int, work string")
    t = evaluation.served_totals(logged, evidence).first().asDict()
    assert t == {"n": 1, "returned": 1, "passed": 1, "hit10": 1, "unscorable": 1, "correct_not_found": 1, "ungraded": 2}


def test_printed_pages(spark):
    pages = {1: ["4"], 2: ["5", "9"], 3: [], 4: ["7"], 5: ["8"], 6: ["30"], 7: ["31", "9"], 8: ["32", "10"], 9: ["zz"]}
    number = {t: ("arabic", int(t)) for ts in pages.values() for t in ts if t.isdigit()}
    data = [("b", p, [(*number[t], t) for t in ts if t in number]) for p, ts in pages.items()]
    got = passages.printed_pages(spark.createDataFrame(data, f"book_id string, pdf_page int, candidates {passages.CANDIDATES}"))
    assert rows(got, "pdf_page", "printed", "method", "reason") == [
        (1, "4", "read", None), (2, "5", "read", None), (3, "6", "inferred", None), (4, "7", "read", None), (5, "8", "read", None),
        (6, "30", "read", None), (7, None, "none", "ambiguous-header-number"), (8, None, "none", "ambiguous-header-number"), (9, None, "none", "no-header-number"),
    ]


BASE = dict(book_id="b", section_path=["s"], kind="content", ocr=False, check_page=False)


@pytest.mark.parametrize("first, second, joined", [
    ({"text": "it goes"}, {"text": "on here"}, "it goes on here"), ({"text": "hyphen-"}, {"text": "ated"}, "hyphenated"), ({"text": "it ends."}, {"text": "on"}, None), ({"text": "it goes"}, {"text": "On"}, None),
    ({"text": "hyphen-"}, {"text": "Ated"}, "hyphenAted"), ({"text": "a"}, {"text": "b", "section_path": ["t"]}, None), ({"text": "a"}, {"text": "b", "kind": "summary"}, None), ({"text": "a", "ocr": True}, {"text": "b"}, None),
    ({"text": "a"}, {"text": "b", "check_page": True}, None), ({"text": "a"}, {"text": "b", "book_id": "c"}, None), ({"text": "a"}, {"text": "b", "pdf_start": 1}, None), ({"text": "a"}, {"text": "b", "pdf_start": 4}, None),
])
def test_cross_page_join_boundaries(spark, first, second, joined):
    one, two = BASE | {"ord": 1, "pdf_start": 1, "pdf_end": 1} | first, BASE | {"ord": 2, "pdf_start": 2} | second
    two = two | {"pdf_end": two["pdf_start"]}
    schema = "book_id string, ord int, pdf_start int, pdf_end int, section_path array<string>, kind string, text string, ocr boolean, check_page boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in (one, two)], schema)
    hidden = spark.createDataFrame([("b", 3)], "book_id string, pdf_page int")
    got = [r["text"] for r in passages.join_across_pages(df, hidden).collect()]
    assert got == [joined] if joined else len(got) == 2


def test_breadcrumbs_prefixes_and_figures(spark):
    paths = spark.createDataFrame([("b", 1, None), ("b", 2, ["x"]), ("b", 3, None), ("b", 4, []), ("b", 5, None)], "book_id string, pdf_page int, path array<string>")
    assert [r["path"] for r in passages.breadcrumbs(paths).orderBy("pdf_page").collect()] == [None, ["x"], ["x"], [], []]
    prefixes = passages.path_prefixes(spark.createDataFrame([("b", ["x", "y"], 4), ("b", ["x"], 9), ("b", ["x", "z"], 2)], "book_id string, path array<string>, page int"))
    assert rows(prefixes.select(F.array_join("prefix", ">"), "page")) == [("x", 2), ("x>y", 4), ("x>z", 2)]
    captions = spark.createDataFrame([("b", 1, "3", "t", i) for i in range(3)], "book_id string, pdf_page int, identifier string, text string, ord int")
    assert passages.figure_ids(captions).select("id").distinct().count() == 3


@pytest.mark.parametrize("text, found", [
    ("See Figure 3.1, 3.2 and 4a.", [("figure", "3.1"), ("figure", "3.2"), ("figure", "4a")]), ("fig 7-2 y 7-3", [("figure", "7-2"), ("figure", "7-3")]), ("tabla 4; Tables 5 and 6", [("table", "4"), ("table", "5"), ("table", "6")]),
    ("pp. 12-14", [("page", "12")]), ("páginas 3, 4", [("page", "3"), ("page", "4")]), ("capítulo 9", [("chapter", "9")]), ("sección 2.1", [("section", "2.1")]), ("no figures here", []), ("", []),
])
def test_references(spark, text, found):
    got = navigation.find_references(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r["kind"], r["identifier"]) for r in got] == found


HEAD = {k: re.compile(rf"\b{p}\s*({navigation.IDENTIFIER})\b", re.I) for k, p in navigation.PREFIXES.items()}
MORE = re.compile(rf"{navigation.SEPARATOR}({navigation.IDENTIFIER})\b", re.I)


def mentions(text):
    """Plain version: each head, then identifiers for as long as one follows at once."""
    out = []
    for kind, head in HEAD.items():
        for m in head.finditer(text):
            spans = [(m.start(), m.end(), re.split("[-–—]", m[1])[0] if kind == "page" else m[1])]
            while more := MORE.match(text, spans[-1][1]):
                spans.append((*more.span(1), more[1]))
            out += [(a, b, kind, name) for a, b, name in spans]
    return sorted(out)


def test_references_equal_the_plain_version(spark):
    rnd = random.Random(3)
    parts = ["Figure ", "fig. ", "Tabla ", "pp. ", "páginas ", "chapter ", "secciones ", "3", "3.1", "7-2", "4a", "12–14", ", ", " and ", " y ", ", e ", "x", "é", "\0", "\n", "p.", "FIG", "٣"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(600)]
    got = navigation.find_references(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    want = sorted((i, *m) for i, t in enumerate(texts) for m in mentions(t.replace("\0", "")))
    assert sorted((r["i"], r["start"], r["end"], r["kind"], r["identifier"]) for r in got) == want and len(want) > 150


def test_references_are_found_in_whole_texts(spark, tmp_path):
    texts = ["x " * 40 + "see p. 12 and Figure 3.1", "none", None]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    said = {r["doc_id"]: r["text"] for r in queries._mentions(spark, str(tmp_path)).collect()}
    want = sorted((i, kind, name, start) for i, t in said.items() for start, _, kind, name in mentions(t))
    assert rows(queries.references_found(spark, str(tmp_path)), "doc_id", "kind", "identifier", "start") == want
    assert [w[1:3] for w in want if w[3] >= 60] == [("figure", "3.1"), ("page", "12")]
    assert rows(queries._resolved(spark, str(tmp_path)), "doc_id", "kind", "identifier", "start") == want


def test_excluded_paths_show_as_empty_but_are_carried(spark):
    paths = [("b", 1, ["x"]), ("b", 2, ["x", "Index"]), ("b", 3, None), ("b", 4, ["y"])]
    got = passages.breadcrumbs(spark.createDataFrame(paths, "book_id string, pdf_page int, path array<string>"))
    assert [r["path"] for r in got.orderBy("pdf_page").collect()] == [["x"], [], [], ["y"]]
    flat = spark.createDataFrame([("b", 1, "x"), ("b", 2, " Contents "), ("b", 3, None)], "book_id string, pdf_page int, path string")
    assert [r["path"] for r in passages.breadcrumbs(flat).orderBy("pdf_page").collect()] == ["x", "", ""]


def test_resolution_needs_one_target(spark):
    refs = navigation.find_references(spark.createDataFrame([("b", "Fig. 1.1 Fig. 2 page 12"), ("b", None)], "book_id string, text string"))
    figures = spark.createDataFrame([("b", "1-1", 3, "f1"), ("b", "2", 4, "f2"), ("b", "2", 5, "f3")], "book_id string, identifier string, page int, figure_id string")
    empty = spark.createDataFrame([], "book_id string, identifier string, title string, depth int, page int")
    printed = spark.createDataFrame([("b", "12", 20)], "book_id string, printed string, page int")
    got = navigation.resolve(refs, navigation.targets(figures, empty, empty, printed))
    assert rows(got, "kind", "identifier", "target_page") == [("figure", "1.1", 3), ("figure", "2", None), ("page", "12", 20)]
    checks = spark.createDataFrame([("figure", i < 9) for i in range(10)] + [("page", i < 8) for i in range(10)], "kind string, correct boolean")
    assert {r["kind"] for r in navigation.precision_gate(got, checks).collect()} == {"figure"}


def test_numbered_parents(spark):
    heads = spark.createDataFrame([("b", n, i) for i, n in enumerate(["1", "1.2", "1.2.3", "1.4.1", "2.1"])], "book_id string, number string, page int")
    assert {r["number"]: r["parent"] for r in navigation.numbered_parents(heads).collect()} == {"1": None, "1.2": "1", "1.2.3": "1.2", "1.4.1": "1", "2.1": None}


def test_suggested_pages_and_recovery(spark):
    data = [("q", "a", 2, 3, 1, None, False), ("q", "a", 1, 2, 2, True, False), ("q", "a", 4, 4, 1, True, True)]
    got = labels.suggested_pages(spark.createDataFrame(data, "qid string, book string, pdf_start int, pdf_end int, rank int, grade boolean, wider boolean"))
    assert rows(got, "position", "page", "passed") == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 4, False)]
    node = "id string, book_id string, pdf_start int, pdf_end int"
    logged = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 3)], "qid string, id string, rank int")
    met = labels.recover(logged, spark.createDataFrame([("x", "a", 1, 1)], node), spark.createDataFrame([("x", "b", 9, 9), ("y", "b", 2, 2)], node))
    assert rows(met, "rank", "book_id") == [(1, "a"), (2, "b"), (3, None)]


def test_owned_evidence(spark):
    log = spark.createDataFrame([("1", "me", [("a", True), ("b", False), ("c", None)])], "id string, asker string, grades array<struct<id:string,grade:boolean>>")
    evidence = spark.createDataFrame([("1", x) for x in "abc"], "question string, id string")
    assert rows(labels.owned(log, evidence, "1", "me"), "id") == [("a",)] and labels.owned(log, evidence, "1", "you").count() == 0


def test_quality(spark):
    values = spark.createDataFrame([("x", v) for v in (1, 2, 3)] + [("y", None)], "g string, v int")
    assert rows(quality.indexed_quantiles(values, "v", ["g"], (0, 0.9, 1)), "q", "value") == [(0.0, 1), (0.9, 2), (1.0, 3)]
    pages = spark.createDataFrame([("b", 1, "own", "born-digital"), ("b", 2, "own", "hidden"), ("b", 3, "own", "no-text")], "book_id string, pdf_page int, text string, source string")
    kept = spark.createDataFrame([("b", p, "read") for p in (1, 2)], "book_id string, pdf_page int, text string")
    solved = spark.createDataFrame([("b", 1, "said")], "book_id string, pdf_page int, text string")
    assert rows(quality.overlaid(pages, kept, solved), "pdf_page", "text", "source") == [(1, "said", "ocr"), (2, "own", "hidden"), (3, "own", "no-text")]
    history = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "book string, time int, action string")
    assert quality.latest(history, ["book"], "time").first()["action"] == "y"


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "id string, v int")
    assert rows(store.upsert(old, new, ["id"])) == [("a", 1), ("b", 3), ("c", 5)] and rows(store.append_first(old, new, ["id"], "v")) == [("a", 1), ("b", 2), ("c", 4)]
    assert rows(store.merge_update(old, new.where("id = 'b'"), ["id"], ["v"])) == [("a", 1), ("b", 3)]
    assert rows(store.insert_missing(new, old), "id") == [("c",)] and store.ingest_summary(new, old).first()["duplicates"] == 1
    registry = spark.createDataFrame([("t", "m", 3)], "table_name string, model string, dimensions int")
    assert store.register(registry, "u", "m", 4).count() == 2 and store.register(registry, "t", "m", 3).count() == 1
    with pytest.raises(ValueError):
        store.register(registry, "t", "m", 4)
    path = str(tmp_path / "log.jsonl")
    assert store.export(old, path, ["id"]) == 2 and store.export(old.withColumn("v", F.lit(9)), path, ["id"]) == 2
    with pytest.raises(ValueError):
        store.export(old.limit(1), path, ["id"])
    assert spark.read.json(path).where("v = 9").count() == 2


@pytest.mark.parametrize("reply, holds", [
    ('{"sentences": [{"text": "So it is.", "citations": [1]}]}', True), ('{"sentences": []}', False), ("nonsense", False), (None, False), ('{"sentences": [{"text": "A. B.", "citations": [1]}]}', False),
    ('{"sentences": [{"text": "x [1].", "citations": [1]}]}', False), ('{"sentences": [{"text": "x.", "citations": []}]}', False), ('{"sentences": [{"text": "x.", "citations": [7]}]}', False), ('{"sentences": [{"text": "x.", "citations": [true]}]}', False),
])
def test_answers(spark, reply, holds):
    df = spark.createDataFrame([(reply,)], "r string").select(answers.answer_holds(answers.answer_of(F.col("r")), F.array(F.lit(1), F.lit(2))))
    assert df.first()[0] == holds


def test_model_calls_in_batches(spark):
    df = answers.with_reply(spark.createDataFrame([("a",), ("b",)], "p string"), lambda texts: [t.upper() if t == "a" else None for t in texts], "p")
    assert rows(df.where("reply is not null")) == [("a", "A")]
    assert answers.with_embedding(df, lambda ts: [[1.0, 2.0] for _ in ts], 2, "p").first()["embedding"] == [1.0, 2.0]


def test_run_counts(spark):
    records = spark.createDataFrame([("a", 1, "confirmed", False), ("b", 3, "draft", False), ("c", 2, "retired", False), ("d", 1, "confirmed", True), ("e", 1, "confirmed", False)], "id string, set_version int, status string, expect_not_found boolean")
    bad, scored = spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("a",)], "qid string")
    got = evaluation.run_counts(records, bad, scored).first().asDict()
    assert got == {"set_version": 3, "retired": 1, "retrieved": 4, "answerable": 3, "not_found": 1, "scored": 1, "skipped_status": 1, "skipped_evidence": 1, "malformed": 1, "read": 6}


def test_books_and_chapters(spark):
    p = spark.createDataFrame([("b", "content", 1, 3), ("b", "summary", 9, 9), ("c", "content", 1, 2)], "book_id string, kind string, pdf_start int, pdf_end int")
    pages = spark.createDataFrame([("b", i, "ocr" if i < 3 else "born-digital") for i in range(1, 5)] + [("c", 1, "ocr"), ("c", 2, "hidden")], "book_id string, pdf_page int, text_source string")
    assert rows(navigation.scanned_books(navigation.content_pages(p), pages)) == [("b", True), ("c", False)]
    heads = spark.createDataFrame([("b", n) for n in ("1", "2", "5", "5.1", "x")], "book_id string, number string")
    assert rows(navigation.chapter_gaps(heads)) == [("b", 3), ("b", 4)]


def test_caches_by_fingerprint(spark):
    inputs = spark.createDataFrame([("b", "f1", 3), ("b", "f2", 4), ("c", "f1", 3)], "book_id string, file string, size int")
    one = store.fingerprints(inputs, ["book_id"], ["file", "size"])
    two = store.fingerprints(inputs.orderBy(F.desc("file")).union(spark.createDataFrame([("c", "f9", 1)], inputs.schema)), ["book_id"], ["file", "size"])
    cache = one.withColumn("pages", F.lit("kept"))
    assert rows(store.fresh(cache, one, ["book_id"]), "book_id") == [("b",), ("c",)] and rows(store.fresh(cache, two, ["book_id"]), "book_id") == [("b",)]


def test_merge_update_doubles_no_row(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    changes = spark.createDataFrame([(1, "c", None, 1), (1, "d", None, 2), (1, None, "z", 3), (9, "q", "q", 1)], "k int, v string, w string, t int")
    assert rows(store.merge_update(stored, changes, ["k"], ["v", "w"], "t"), "k", "v", "w") == [(1, "d", "z"), (2, "b", "y")]


def test_repeated_labels_and_ids_double_no_row(spark):
    log = spark.createDataFrame([(1, "2024-01-05 10:00:00")], "id int, asked_at string")
    marks = spark.createDataFrame([(1, True), (1, True)], "log_id int, expect_not_found boolean")
    assert labels.log_listing(log, marks).count() == 1
    nodes = spark.createDataFrame([("n", "b", 1, 2), ("n", "b", 1, 2)], "id string, book_id string, pdf_start int, pdf_end int")
    assert labels.recover(spark.createDataFrame([("q", "n", 1)], "qid string, id string, rank int"), nodes).count() == 1


def test_export_leaves_nothing_aside(spark, tmp_path):
    one = spark.createDataFrame([(1,), (2,)], "a int")
    for _ in range(2):
        assert store.export(one, f"{tmp_path}/x", ["a"]) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["x"] and spark.read.text(f"{tmp_path}/x").count() == 2


def test_printed_ranges(spark):
    pages = spark.createDataFrame([("b", 1, "i", None), ("b", 2, "ii", None), ("b", 3, None, "z"), ("b", 4, None, "a"), ("b", 5, "v", "")], "book_id string, pdf_page int, printed string, reason string")
    own = spark.createDataFrame([("p", "b", 1, 2), ("q", "b", 2, 4), ("r", "b", 5, 5)], "id string, book_id string, pdf_start int, pdf_end int")
    assert rows(passages.printed_ranges(own, pages), "id", "first", "last", "reason") == [("p", "i", "ii", None), ("q", None, None, "a;z"), ("r", "v", "v", None)]


def test_join_stops_at_hidden_pages(spark):
    shape = "book_id string, ord int, pdf_start int, pdf_end int, section_path array<string>, kind string, text string, ocr boolean, check_page boolean"
    own = spark.createDataFrame([("b", i, p, p, ["s"], "content", f"and so {i}", False, False) for i, p in enumerate([1, 3, 4, 7])], shape)
    hidden = spark.createDataFrame([("b", 2), ("b", 9), ("c", 5)], "book_id string, pdf_page int")
    assert rows(passages.join_across_pages(own, hidden), "pdf_start", "pdf_end", "n_parts") == [(1, 1, 1), (3, 7, 3)]


def test_figure_nodes_follow_passages(spark):
    figures = spark.createDataFrame([("f", "b", "Fig 1", "cap\0", 9, "8", 8, "7"), ("g", "b", "Fig 2", "c", 9, "8", None, None)], "id string, book_id string, label string, caption string, pdf_page int, printed string, legend_page int, legend_printed string")
    both = passages.index_rows(spark.createDataFrame([("p", "b", "content", "t")], "id string, book_id string, kind string, text string"), figures)
    assert rows(both, "id", "kind", "pdf_start", "text") == [("f", "figure", 8, "Fig 1\n\ncap"), ("g", "figure", 9, "Fig 2\n\nc"), ("p", "content", None, "t")]


def test_links_flags_and_evidence(spark):
    found = spark.createDataFrame([("q", 1, "b", "x"), ("q", 2, "b", "y")], "qid string, rank int, book_id string, id string")
    links = spark.createDataFrame([("b", "x", 5, 6, "page", "t"), ("b", "x", 1, 2, "figure", "u")], "book_id string, id string, start int, end int, kind string, target string")
    got = {r["id"]: [x["start"] for x in r["links"]] for r in retrieval.with_links(found, links).collect()}
    assert got == {"x": [1, 5], "y": []}
    flags = spark.createDataFrame([("q", 1, True), ("q", 2, None)], "qid string, rank int, flag boolean")
    assert rows(retrieval.with_flags(found, flags), "id", "flag") == [("x", True), ("y", None)]
    with pytest.raises(Exception, match="as many flags"):
        retrieval.with_flags(found, flags.limit(1)).collect()
    node = spark.createDataFrame([("n", "t", '{"book_id": "b", "pdf_start": 3, "caption": "c"}')], "id string, text string, metadata string")
    r = retrieval.evidence_of(node).first()
    assert (r["text"], r["kind"], r["pdf_end"], r["figures"], r["check_page"]) == ("c", "content", 3, [], False)


def test_gates_sets_and_runs(spark, tmp_path):
    run = lambda hits: spark.createDataFrame([(i, i < hits, True, "words") for i in range(4)], "qid int, hit5 boolean, hit10 boolean, note string")
    cohort = spark.createDataFrame([(0,), (1,)], "qid int")
    gate = evaluation.figure_gate(run(4), run(2), cohort, 4, 2).collect()
    assert [(r["run"], r["hit5"], r["passed"]) for r in gate] == [("baseline", 4, True), ("candidate", 2, True)]
    with pytest.raises(ValueError):
        evaluation.figure_gate(run(4), run(2).where("qid > 0"), cohort, 4, 2)
    with pytest.raises(ValueError):
        evaluation.figure_gate(run(4), run(2), cohort, 5, 2)
    evaluation.write_run(run(4), f"{tmp_path}/run", "eval", "embed", 2)
    back = spark.read.json(f"{tmp_path}/run")
    assert "note" not in back.columns and back.where("kind = 'eval' and set_version = 2").count() == 4
    with pytest.raises(Exception, match="exists"):
        evaluation.write_run(run(4), f"{tmp_path}/run", "eval", "embed", 2)
    records = spark.createDataFrame([(3, "retired"), (1, "confirmed"), (2, "draft")], "line int, status string")
    assert evaluation.active(records).count() == 2 and [r["line"] for r in evaluation.first_asked(records, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        evaluation.active(records.where("line = 3"))


def test_expected_pages_and_store_edges(spark, tmp_path):
    evidence = spark.createDataFrame([(1, "E", [4, 5, 4]), (1, "lost", [1])], "qid int, book string, pages array<int>")
    books = spark.createDataFrame([("b", "E"), ("c", None)], "id string, eval_book string")
    assert rows(labels.expected_pages(evidence, books), "qid", "book_id", "page") == [(1, "b", 4), (1, "b", 5)]
    registry = spark.createDataFrame([("t2", "m", 3), ("t1", "a", 4)], "table_name string, model string, dimensions int")
    assert [r["table_name"] for r in store.models(registry).collect()] == ["t1", "t2"]
    assert store.model_of(registry, "t2", lambda t: t == "t2") == ("m", 3, True) and store.model_of(registry, "x", bool) is None
    asked = store.question_row(spark.createDataFrame([("a\0b", "me", None)], "question string, asker string, language string")).first()
    assert (asked["question"], asked["language"], asked["evidence"], asked["ungraded_count"]) == ("ab", "en", [], 0)
    (tmp_path / ".git").mkdir()
    with pytest.raises(ValueError):
        store.outside_checkout(f"{tmp_path}/out/x")
    grown = store.widened(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([], "a int, b string"))
    assert grown.columns == ["a", "b"] and store.appended(spark.createDataFrame([], "a int, time timestamp"), spark.createDataFrame([(1,)], "a int")).first()["time"] is not None


def test_numbered_tree(spark):
    own = spark.createDataFrame([("b", "1", "One", 3), ("b", "1", "One again", 9), ("b", "1.2", "x", 4), ("b", "1.2.1.1", "y", 5), ("b", "7.1", "orphan", 6)], "book_id string, number string, title string, page int")
    assert rows(navigation.numbered_tree(own), "number", "title", "parent", "depth") == [("1", "One", None, 1), ("1.2", "x", "1", 2), ("1.2.1.1", "y", "1.2", 3)]
