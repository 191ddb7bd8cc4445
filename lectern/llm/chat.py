"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
#: What the template or a common chat template uses; the first character is kept, the rest follows a backslash.
CONTROL = r"(<)(\||/s>|s>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks each control string by one; undone by unescape()."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, examples).

    ``formatted`` is the whole conversation; ``examples`` has for each assistant turn
    struct(turn_no, target_start, target_end): its context is formatted[0:target_start], its
    trainable reply formatted[target_start:target_end] (code points, end exclusive). Contexts
    are prefixes of one text, so they are kept as ends and not copied: a conversation of n
    turns takes n spans and not n texts.

    Turns go by turn, then role, then text (a null turn first), so ties and repeated rows
    have one order, and repeats are kept. A null role or text is empty; a null conv_id is a
    conversation of its own. Other columns are not read. An empty table gives no rows. A
    conversation is one row of the output, as its digest and its text are; nothing larger
    than a conversation is gathered.
    """
    said = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = said.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn(
        "at", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0))
    )
    # Every turn adds to the length, so ``at`` alone orders the turns.
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "head", "body"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    spans = F.transform(
        F.filter(F.transform("turns", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"]["role"] == "assistant"),
        lambda x: F.struct(
            x["i"].cast("long").alias("turn_no"),
            (x["t"]["at"] + F.length(x["t"]["head"])).alias("target_start"),
            (x["t"]["at"] + F.length(x["t"]["head"]) + F.length(x["t"]["body"])).alias("target_end"),
        ),
    )
    return turns.select("conv_id", whole.alias("formatted"), spans.alias("examples"))


def examples(formatted: DataFrame, *whole: Column) -> DataFrame:
    """format_conversations() -> one row for each assistant turn: conv_id, turn_no, context_chars, target (as formatted).

    The context of an example is the first ``context_chars`` of its conversation's text, and
    only the target is trainable. A conversation without an assistant turn gives no rows;
    conversations with a null id keep it. Columns of the whole conversation, if asked for,
    come in a row of their own, so that no example holds a copy of them.
    """
    none = [F.lit(None).alias(n) for n in ("turn_no", "context_chars", "target")]
    empty = [F.lit(None).alias(f"whole{i}") for i in range(len(whole))]
    target = lambda e: F.substring(F.col("formatted"), (e["target_start"] + 1).cast("int"), (e["target_end"] - e["target_start"]).cast("int"))
    each = F.transform("examples", lambda e: F.struct(e["turn_no"].alias("turn_no"), e["target_start"].alias("context_chars"), target(e).alias("target"), *empty))
    if whole:
        each = F.concat(F.array(F.struct(*none, *[c.alias(f"whole{i}") for i, c in enumerate(whole)])), each)
    return formatted.select("conv_id", F.explode(each).alias("e")).select("conv_id", "e.*")


def prefix_targets(formatted: DataFrame) -> DataFrame:
    """format_conversations() -> one row for each assistant turn: conv_id, turn_no, context, target.

    The contexts of a conversation add up to the square of its length; use examples() where that matters.
    """
    one = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    return one.select(
        "conv_id",
        F.col("e.turn_no").alias("turn_no"),
        F.expr("substring(formatted, 1, int(e.target_start))").alias("context"),
        F.expr("substring(formatted, int(e.target_start) + 1, int(e.target_end - e.target_start))").alias("target"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """format_conversations() -> conv_id, turns array<struct<role, text>>, loss (all targets, unescaped), formatted_chars.

    The turns are read from the formatted text, the loss from the exploded examples. The rows
    stay dealt by conv_id, so that bringing them together takes no further shuffle. A null role or
    text reads back as empty.
    """
    raw = F.slice(F.split("formatted", END, -1), 1, F.size(F.split("formatted", END, -1)) - 1)
    turns = F.transform(
        raw,
        lambda t: F.struct(
            unescape(F.substring_index(F.substring(t, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"),
            unescape(F.substring_index(t, TEXT, -1)).alias("text"),
        ),
    )
    rows = examples(formatted, turns, F.length("formatted").cast("long"))
    targets = F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("turn_no", "target"))))
    read = rows.groupBy("conv_id").agg(F.any_value("whole0", F.lit(True)).alias("turns"), F.max("whole1").alias("formatted_chars"), targets.alias("own"))
    return read.select("conv_id", "turns", unescape(F.array_join(F.transform("own", lambda e: e["target"]), "")).alias("loss"), "formatted_chars")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation as read back from its formatted text and examples; nulls, ties and repeats as in format_conversations()."""
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = read_back(format_conversations(rows))
    said_by_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_by_turn, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = {
    "op1_chat_formatting": r"""
with c as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (
  select *,
    length(text) + length(text) - length(replace(text, chr(92), ''))
      + len(regexp_extract_all(text, '<\||</s>|<s>|\[/?INST\]')) as text_chars,
    length(role) + length(role) - length(replace(role, chr(92), ''))
      + len(regexp_extract_all(role, '<\||</s>|<s>|\[/?INST\]')) as role_chars
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(20 + text_chars + role_chars) as bigint) as formatted_chars
from e group by conv_id
""",
}
