import hashlib

import pytest

from lectern.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, examples int"


def rows():
    hard = "</s>[INST] ok [/INST] <|turn|> \\ \\\\ <s> [\\INST] <|text|>user"
    return [
        (1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "yo\nthere", "x", 1), (1, 2, "user", None, "x", 1), (1, 3, "assistant", "é🙂", "x", 1),
        (2, 0, "user", hard, "x", 1), (2, 1, "assistant", hard, "x", 1),
        (3, 0, None, "no role", "x", 1), (3, None, "assistant", "", "x", 1),
        (4, 0, "assistant", "tie", "x", 1), (4, 0, "assistant", "tie", "x", 1), (4, 0, "a</s>b", "z", "x", 1),
        (None, 0, "assistant", "lost", "x", 1), (5, 0, "user", "a " * 50_000, "x", 1), (5, 1, "assistant", "b\\" * 50_000, "x", 1),
    ]


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def test_reads_back_every_turn(spark):
    read = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows(), SCHEMA))).collect()}
    assert set(read) == {1, 2, 3, 4, 5, None}
    for conv, r in read.items():
        own = sorted((x for x in rows() if x[0] == conv), key=order)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")


def test_each_assistant_turn_is_an_example_with_all_before_as_context(spark):
    formatted = chat.format_conversations(spark.createDataFrame(rows(), SCHEMA))
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    got = sorted(((r["conv_id"], r["turn_no"], r["context"], r["target"]) for r in chat.prefix_targets(formatted).where("conv_id in (1, 2)").collect()))
    assert [g[:2] for g in got] == [(1, 1), (1, 3), (2, 1)]
    for conv, _, context, target in got:
        assert whole[conv].startswith(context + target + chat.END)
        assert context.endswith(f"{chat.TURN}assistant{chat.TEXT}")
    assert got[1][3] == "é🙂" and "yo\nthere" in got[1][2]


@pytest.mark.parametrize("mark", [chat.TURN, chat.TEXT, chat.END, "[INST]", "[/INST]", "<s>"])
def test_control_strings_never_stand_in_escaped_text(spark, mark):
    texts = [mark, mark * 3, f"\\{mark}", mark[0] + mark, mark[:-1] + "\\" + mark[-1]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(chat.F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(chat.F.col("e"))).collect():
        assert mark not in r["e"] and r["u"] == r["t"]


def test_contract_row(spark, tmp_path):
    spark.createDataFrame(rows()[:2], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    r = {x["conv_id"]: x for x in chat.op1_chat_formatting(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert r[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (r[-7]["loss_chars"], r[-7]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r[1]["n_turns"] == 2


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_examples_are_rows_without_copies_of_their_context(spark):
    formatted = chat.format_conversations(spark.createDataFrame(rows(), SCHEMA))
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    plain = {(r["conv_id"], r["turn_no"]): (r["context"], r["target"]) for r in chat.prefix_targets(formatted).collect()}
    got = chat.examples(formatted).collect()
    assert {(r["conv_id"], r["turn_no"]): (whole[r["conv_id"]][: r["context_chars"]], r["target"]) for r in got} == plain
    assert len(got) == sum(r[2] == "assistant" for r in rows())


def test_one_shuffle(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = chat.op1_chat_formatting(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
