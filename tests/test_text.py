import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize("path, kind", [
    (["Part", "Summary"], "summary"), (["RESU MEN", "Body"], "summary"), (["Summary", "Glossary"], "glossary"), (["Problemas"], "exercise"),
    (["Bibliografía"], "references"), (["Summary of it"], "content"), ([], "content"), (["Respuestas a los\nproblemas"], "exercise"),
])
def test_passage_kind(spark, path, kind):
    assert one(spark, T.passage_kind(F.col("p")), p=path) == kind


def test_excluded_section_keeps_inner_spaces(spark):
    assert one(spark, T.excluded_section(F.col("p")), p=["x", " Detailed Contents "])
    assert not one(spark, T.excluded_section(F.col("p")), p=["Con tents"])


@pytest.mark.parametrize("text, number", [("12", ("arabic", 12)), ("xiv", ("roman", 14)), ("MCMXC", ("roman", 1990)), ("A-7", ("prefix:A-", 7)), ("S:12", ("prefix:S:", 12)), ("a:4", ("prefix:a:", 4)), ("\t12\n", ("arabic", 12)), ("123456", None), ("IIII", None), ("", None), ("7a", None)])
def test_printed_number(spark, text, number):
    found = one(spark, T.printed_number(F.col("t")), t=text)
    assert (found and tuple(found)) == number


@pytest.mark.parametrize("kind, value, example, text", [("arabic", 9, "8", "9"), ("roman", 14, "xiii", "xiv"), ("roman", 1994, "MCM", "MCMXCIV"), ("prefix:S-", 4, "S-3", "S-4")])
def test_format_number(spark, kind, value, example, text):
    assert one(spark, T.format_number(F.col("k"), F.col("v"), F.col("e")), k=kind, v=value, e=example) == text


def test_join_lines(spark):
    assert one(spark, T.join_lines(F.col("x")), x=["cé-", "lulas and", " Nine-", "Ten", "soft­", "ware"]) == "células and Nine- Ten software"


@pytest.mark.parametrize("text", ["plain", 'q"uote \\ back', "tab\tline\nfeed\r\f\b", "é😀\x1f\x01", ""])
def test_passage_id_equals_the_json_digest(spark, text):
    want = hashlib.sha256(json.dumps(["bk", [1, 2], text], ensure_ascii=False).encode()).hexdigest()
    assert one(spark, T.passage_id(F.lit("bk"), F.lit(1), F.lit(2), F.col("t")), t=text) == want


def test_labels_names_and_keys(spark):
    none = F.lit(None).cast("string")
    assert one(spark, T.passage_label(F.lit("b"), F.lit(3), F.lit(4), F.lit("ix"), F.lit("x"), none)) == "b: pdf pages 3–4 <print pages: ix–x>"
    assert one(spark, T.passage_label(F.lit("b"), F.lit(3), F.lit(3), none, none, F.lit("hidden"))) == "b: pdf page 3 <print page unknown: hidden>"
    digest = hashlib.sha256(b"Qwen/Embed 8B").hexdigest()[:16]
    assert one(spark, T.table_name("v6", F.lit("Qwen/Embed 8B"), roles=True)) == f"e_v6r_qwen_embed_8b_{digest}"
    assert one(spark, T.table_name("v6", F.lit("Qwen/Embed 8B"), roles=True, purpose="embed-large")) == f"e_v6_qwen_embed_8b_{digest}"
    assert one(spark, T.identifier_key(F.lit("7.3–A"))) == "7-3-a" and one(spark, T.figure_key(F.lit("7.3–A"))) == "7.3-a"
    assert one(spark, T.version_at_least(F.lit("v10"), 6)) and not one(spark, T.version_at_least(F.lit("v2"), 5))


@pytest.mark.parametrize("reply, grade", [(" YES ", True), ("no", False), ("maybe", None), ("", None)])
def test_parse_grade(spark, reply, grade):
    assert one(spark, T.parse_grade(F.col("t")), t=reply) is grade


@pytest.mark.parametrize("text, n, bad", [("The cat (sat).", 3, 0), ("xq zz 12a ... a", 4, 4), ("", 0, 0), ("a word", 2, 1)])
def test_nonwords(spark, text, n, bad):
    assert tuple(one(spark, T.nonwords(F.col("t")), t=text)) == (n, bad)


def rules(spark, text, source="ocr", ink=True, finish="stop", language="en", detected="en", candidates=((("arabic", 5)),), neighbours=()):
    cands = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in candidates]) if candidates else F.array().cast("array<struct<kind:string,value:int>>")
    shape = "array<struct<offset:int,candidates:array<struct<kind:string,value:int>>>>"
    near = F.array(*[F.struct(F.lit(o).alias("offset"), F.array(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"))).alias("candidates")) for o, k, v in neighbours]) if neighbours else F.array().cast(shape)
    return one(spark, T.failed_rules(F.col("t"), F.lit(source), F.lit(ink), F.lit(finish), F.lit(language), F.lit(detected), cands, near), t=text)


def test_failed_rules(spark):
    good = "The house is here and there. " * 4
    five = [("arabic", 5)]
    assert rules(spark, good, candidates=five) == []
    assert rules(spark, "x", source="hidden", candidates=()) == []
    assert rules(spark, good, finish="length", candidates=five) == ["token-limit"]
    assert rules(spark, "a" * 39, candidates=five) == ["empty-ink"] and rules(spark, "a" * 40, candidates=five) == []
    assert rules(spark, "zx " * 50, candidates=five) == ["nonwords"] and rules(spark, "zx " * 49, candidates=five) == []
    assert rules(spark, good * 9, detected="es", candidates=five) == ["language"]
    assert rules(spark, good, candidates=()) == ["number-missing"]
    assert rules(spark, good, candidates=five, neighbours=[(1, "arabic", 9)]) == ["number-order"]
    assert rules(spark, good, candidates=five, neighbours=[(1, "arabic", 9), (-1, "arabic", 4)]) == []
    assert rules(spark, good, source="born-digital", candidates=()) == []


def test_link_segments_part_the_text(spark):
    link = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(f"{a}").alias("target"))
    found = one(spark, T.link_segments(F.col("t"), F.array(link(3, 5), link(1, 4), link(4, 4), link(6, 99))), t="a😀bcdefg")
    assert [(s["text"], s["target"]) for s in found] == [("a", None), ("😀bc", "1"), ("defg", None)]


def test_rates_and_nul(spark):
    assert one(spark, T.rate_text(F.lit(2), F.lit(3))) == "2/3 (67%)" and one(spark, T.rate_text(F.lit(0), F.lit(0))) == "0/0"
    assert one(spark, T.without_nul(F.lit("a\0b"))) == "ab"


@pytest.mark.parametrize("reply, grade", [("yes\n", True), ("\tNO\r\n", False), ("\u00a0yes\u2028", True), ("yes.", None), ("", None), (None, None)])
def test_grades_without_white_space_of_any_kind(spark, reply, grade):
    assert spark.createDataFrame([(reply,)], "r string").select(T.parse_grade(F.col("r"))).first()[0] is grade


@pytest.mark.parametrize("hits, n, text", [(1, 8, "1/8 (12%)"), (5, 8, "5/8 (62%)"), (3, 8, "3/8 (38%)"), (0, 0, "0/0")])
def test_rates_round_halves_to_even(spark, hits, n, text):
    assert spark.createDataFrame([(hits, n)], "h int, n int").select(T.rate_text(F.col("h"), F.col("n"))).first()[0] == text


@pytest.mark.parametrize("text", ["a\x0bb\x0cc\x85d\u2028e\r\n f\t\n", "", "x\n\ny", "\n", "one Copyrighted material", "a\x1cb"])
def test_reading_lines_split_and_strip_at_every_line_end(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.reading_lines(F.col("t"))).first()[0]
    assert got == [x.replace("Copyrighted material", "").strip() for x in text.splitlines()]


def test_captions_and_nul(spark):
    df = spark.createDataFrame([("Figura 3-12 x", "Table 2.1 a\nb\n tabla 7: c", {"a\0": "x\0y", "b": "z"})], "c string, t string, m map<string,string>")
    r = df.select(T.caption_identifier(F.col("c")), T.caption_identifier(F.col("t")), T.table_identifiers(F.col("t")), T.map_without_nul(F.col("m"))).first()
    assert tuple(r) == ("3-12", None, ["2.1", "7"], {"a": "xy", "b": "z"})
