r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as
context, its own text as the only trainable span. A conversation that does not
end with an assistant turn (or has none) also gives a last example without a
trainable span, so that the examples hold every turn.

A turn is written ``<s>[INST]role[/INST]text</s>``. Inside roles and texts a
control string is escaped by one backslash after its first character, whatever
backslashes stand there already (``</s>`` is ``<\/s>``, ``<\/s>`` is
``<\\/s>``), and reading takes one away: all texts come back as they were.

Defined results: a null text or role is empty; turns are ordered by turn number
(null first), then role, then text, and repeated rows are turns of their own; a
null conversation id is a conversation; an empty table gives no examples;
further input columns are ignored. Training examples are as long as their
conversation's prefix, so the output grows with the square of a conversation's
turns: that is the format, not an accident of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import table

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: A control string with any number of backslashes after its first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MID), escape(text), F.lit(CLOSE))


def examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (0, 1, ...), formatted, loss_start, loss_length (in code points)."""
    turns = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    written = whole.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == target).alias("trains"),
        F.transform("ts", lambda t: format_turn(t["role"], t["text"])).alias("ws"),
        F.transform("ts", lambda t: F.length(escape(t["text"]))).alias("ls"),
    )
    last = F.size("ws") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.col("trains")[i] | (i == last))
    each = written.select("conv_id", "trains", "ws", "ls", F.posexplode(ends).alias("example", "end"))
    formatted = F.array_join(F.slice("ws", 1, F.col("end") + 1), "")
    trained = F.when(F.col("trains")[F.col("end")], F.col("ls")[F.col("end")]).otherwise(0)
    return each.select("conv_id", "example", formatted.alias("formatted"), trained.alias("loss_length")).select(
        "conv_id",
        "example",
        "formatted",
        (F.length("formatted") - len(CLOSE) - F.col("loss_length")).cast("long").alias("loss_start"),
        F.col("loss_length").cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example, as an array of structs of role and text."""
    parts = F.slice(F.split(formatted, CLOSE), 1, F.size(F.split(formatted, CLOSE)) - 1)

    def turn(part: Column) -> Column:
        body = part.substr(F.lit(len(OPEN) + 1), F.length(part))
        cut = F.instr(body, MID)
        return F.struct(
            unescape(body.substr(F.lit(1), cut - 1)).alias("role"),
            unescape(body.substr(cut + len(MID), F.length(body))).alias("text"),
        )

    return F.transform(parts, turn)


def read_target(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example."""
    return unescape(formatted.substr((start + 1).cast("int"), length.cast("int")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = examples(convs).select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_length") > 0, read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))).otherwise("").alias("target"),
        "formatted",
    )
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "target"))), lambda e: e["target"]), "").alias("loss"),
    )
    turns = per.withColumn("turns", read_turns(F.col("whole")))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_by, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, length(ROLE_ESC) + length(TEXT_ESC) + 20 AS chars,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""".replace("ROLE_ESC", _ESC.format("role")).replace("TEXT_ESC", _ESC.format("text"))
