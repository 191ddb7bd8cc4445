import json

import pytest

from lectern.sources import files
from lectern.streaming.ingest import stream_passages

BOOK = '[[books]]\nid = "{id}"\nfilename = "{file}"\ntitle = "T"\nlanguage = "English"\n'


def test_catalogue(spark):
    assert files.catalogue(spark, BOOK.format(id="a-1", file="a.pdf") + BOOK.format(id="b", file="b.PDF")).count() == 2


@pytest.mark.parametrize("text", [BOOK.format(id="A", file="a.pdf"), BOOK.format(id="a", file="../a.pdf"), BOOK.format(id="a", file="a.txt"), BOOK.format(id="a", file="a.pdf") * 2, BOOK.format(id="a", file="a.pdf").replace("T", " ")])
def test_bad_catalogues_fail_whole(spark, text):
    with pytest.raises(ValueError):
        files.catalogue(spark, text)


def test_eval_quarantine(spark):
    good = {"id": "q1", "set_version": 1, "status": "confirmed", "question": "what", "language": "en", "expect_not_found": False, "evidence": [{"book": "b", "work": "w", "state": "confirmed", "pages": [{"pdf": 3, "text": "ok"}]}]}
    pages = lambda p: [{"book": "b", "work": "w", "state": "confirmed", "pages": [p]}]
    lines = [good, None, "{bad", good | {"id": "q2", "status": "x"}, good, good | {"id": "q3", "status": "bad"}, good | {"id": "q3"}, good | {"id": "q4", "language": "fr"}, good | {"id": "has space"},
             good | {"id": "q5", "evidence": pages({"pdf": 1, "pdf_from": 2})}, good | {"id": "q6", "evidence": pages({"pdf_from": 2, "pdf_to": 4})}, good | {"id": "q7", "question": " "}]
    data = [(i, "" if x is None else x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines, 1)]
    records, bad = files.eval_lines(spark.createDataFrame(data, "line int, value string"))
    assert sorted(r["id"] for r in records.collect()) == ["q1", "q6"]
    assert sorted((r["line"], r["name"], r["reason"]) for r in bad.collect()) == [
        (3, "line 3", "not a JSON object"), (4, "q2", "bad status"), (5, "q1", "repeated id"), (6, "q3", "bad status"), (7, "q3", "repeated id"),
        (8, "q4", "bad language"), (9, "line 9", "bad id"), (10, "q5", "bad pages"), (12, "q7", "no question"),
    ]


def test_runs_and_records(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"kind": "run", "format": 1}')
    assert files.run_of(spark, str(tmp_path / "run.json"), "run").count() == 1
    with pytest.raises(ValueError):
        files.run_of(spark, str(tmp_path / "run.json"), "other")
    (tmp_path / "a.png").write_bytes(b"png")
    assert files.binary_pages(spark, str(tmp_path)).count() == 1


def test_streamed_passages_arrive_once(spark, tmp_path):
    passages = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "id string, text string")
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    passages.write.parquet(source)
    stream_passages(spark, source, passages.schema, target, check).awaitTermination(60)
    spark.createDataFrame([("b", "y"), ("c", "z")], passages.schema).write.mode("append").parquet(source)
    stream_passages(spark, source, passages.schema, target, check).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
