"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it, formatted, with a loss mask over that reply
alone. A conversation's turns after its last reply become one more example without a target, so no turn is lost.

A turn is ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Control strings (``CONTROL``) and backslashes inside
texts are escaped by a backslash after the control string's first character and by doubling, which ``unescaped`` undoes.

Defined results: a null text is empty and a null role is the empty role; rows are ordered by turn (nulls first), then
role, then text, so ties and repeated rows are kept in a fixed order; a null conv_id is a conversation; extra columns do
not matter; an empty table gives no examples. A conversation is one example's unit and is held by one task, as its text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.common import table

# The template's marks, and the control strings of it and of other known templates.
START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"
CONTROL = r"(<)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?(?:unk|pad|bos|eos)>)|(\[)(/?INST\]|/?(?:AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])"


def escaped(text: Column) -> Column:
    """Doubles backslashes, then breaks every control string by a backslash after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``: a backslash and a second one, if there is one, become the second."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escaped_role(role: Column) -> Column:
    """``escaped`` for a role, whose line ends at the first newline: a newline becomes one backslash and an n."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, target_turn, n_turns, formatted, loss_start, loss_chars): loss_start is 1-based; null without a target.

    Lengths count code points of ``formatted``, escapes included. A reply that ends the context of a later example is not
    trainable there.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = conversations.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    body = lambda t: escaped(t["text"])
    part = lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (t["role"] == TARGET).alias("reply"))
    parts = turns.select("conv_id", F.transform("turns", part).alias("parts")).select("conv_id", "parts", F.size("parts").alias("n"))
    # Places (1-based) at which an example ends: every reply, and the last turn.
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == F.col("n")) | F.element_at("parts", i)["reply"])
    placed = parts.select("conv_id", "parts", F.posexplode(ends).alias("example", "n_turns"))
    context = F.array_join(F.transform(F.slice("parts", 1, F.col("n_turns") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    last = F.element_at("parts", F.col("n_turns"))
    made = placed.select("conv_id", "example", "n_turns", F.concat(context, last["head"]).alias("before"), last["body"].alias("body"), last["reply"].alias("reply"))
    return made.select(
        "conv_id",
        "example",
        F.when(F.col("reply"), F.col("n_turns")).alias("target_turn"),
        "n_turns",
        F.concat("before", "body", F.lit(END + "\n")).alias("formatted"),
        F.when(F.col("reply"), F.length("before") + 1).alias("loss_start"),
        F.when(F.col("reply"), F.length("body")).alias("loss_chars"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.regexp_replace(F.substring(p, F.instr(p, "\n") + 1, F.length(p)), r"<\|im_end\|>\n\z", "")).alias("text")))


def read_back(made: DataFrame) -> DataFrame:
    """Digests by conversation of what ``made`` holds: turns from its longest example, replies under the loss masks."""
    loss = unescaped(F.substring(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")))
    summed = made.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))))).alias("replies"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns, replies = parsed(F.col("longest")), F.array_join(F.transform("replies", lambda r: r["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return summed.select("conv_id", turns.alias("turns"), replies.alias("loss"), "formatted_chars", "n_examples").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op3_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(examples(rows.unionByName(extra)))


ORACLES = {
    "op3_prefix_targets": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|im_start|>' || role || chr(10) || regexp_replace(replace(text, '\', '\\'), '(<)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?(?:unk|pad|bos|eos)>)|(\[)(/?INST\]|/?(?:AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])', '\1\3\\\2\4', 'g') || '<|im_end|>' || chr(10)) AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM placed)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id""",
}
