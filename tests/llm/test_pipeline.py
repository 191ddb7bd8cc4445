import corpus_pipeline
from lectern.llm import decontaminate, pieces, simhash

BENCH = " ".join(f"b{i}" for i in range(30))


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    clean = {i: f"the ther and ing {' '.join(f'w{i}x{k}' for k in range(40))}" for i in range(8)}
    rows = [(i, t, "en", "s", len(t)) for i, t in clean.items()]
    rows += [(20, clean[0].upper(), "en", "s", 1), (21, "12 34", "en", "s", 5), (22, None, "en", "s", None), (23, "x " + BENCH, "en", "s", 1)]
    rows += [(24, "my password=b7db7aa4a5fcc78305 is long and here it is said again", None, None, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*clean, 24}
    assert all(out[i]["text"] == t for i, t in clean.items()) and "[SECRET]" in out[24]["text"]
    assert all(r["pieces_exact"] and r["pieces"] for r in out.values())


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, documents, tmp_path):
    spark.createDataFrame([(1, BENCH)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert dict(out.dtypes) == dict(documents.dtypes)
            docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]


def test_stages_hand_over_parquet(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, d, _: d.where("doc_id > 0")) for n in ("first", "second")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    files = out.inputFiles()
    assert files and all(f.endswith(".parquet") and "/first/" in f for f in files)


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_operators_are_those_of_the_package():
    assert callable(simhash.keep_one) and callable(decontaminate.decontaminate) and callable(pieces.encode)
