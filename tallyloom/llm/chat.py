"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, and others that texts must not smuggle in.
START, END, ROLE, TEXT = "<s>", "</s>", "[ROLE]", "[/ROLE]"
CONTROL = (START, END, ROLE, TEXT, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """Text without control strings: backslashes are doubled, and one goes into each such string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START + ROLE), escaped(role), F.lit(TEXT), escaped(text), F.lit(END))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 1), text, loss_start and loss_length (code points), final.

    ``turns``: conv_id, turn, role, text.  One example for each assistant turn: all turns before it
    as context, then the turn; only its text is under the loss.  Turns after the last assistant turn
    (or a conversation without one) make one more example without loss, so that nothing is lost; the
    ``final`` example has all turns.  A conversation is the unit of an example and is put together
    in one row; its examples are made one after another from that row.

    Null roles and texts count as empty, turns with equal numbers are ordered by role and text,
    repeated rows are turns of their own, null turn numbers come first, and null conv_ids are one
    conversation.  An empty table gives an empty result; other columns are not looked at.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns")).select(
        "conv_id", F.size("turns").alias("count"),
        F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("answers"),
        F.transform("turns", lambda t: formatted_turn(t["role"], t["text"])).alias("parts"),
        F.transform("turns", lambda t: F.length(escaped(t["text"]))).alias("lengths"))
    ends = F.filter(F.sequence(F.lit(1), F.col("count")),
                    lambda k: F.element_at("answers", k) | (k == F.col("count")))
    each = whole.select("*", F.posexplode(ends).alias("at", "upto"))
    answer = F.element_at("answers", F.col("upto"))
    own = F.element_at("lengths", F.col("upto"))
    made = each.select(
        "conv_id", (F.col("at") + 1).cast("long").alias("example"),
        F.array_join(F.slice("parts", 1, F.col("upto")), "").alias("text"),
        F.when(answer, own).otherwise(0).alias("loss_length"),
        (F.col("upto") == F.col("count")).alias("final"))
    start = F.length("text") - len(END) - F.col("loss_length")
    return made.select("conv_id", "example", "text", start.alias("loss_start"), "loss_length", "final")


def read_turns(text: Column) -> Column:
    """The turns of an example, as an array of (role, text)."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.replace(p, F.lit(START + ROLE)), TEXT, 1)).alias("role"),
        unescaped(F.substring_index(p, TEXT, -1)).alias("text")))


def digests(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from
    ``examples``: the turns from the final example, the loss from the spans of all."""
    under_loss = unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
    narrow = made.select("conv_id", "example", F.length("text").cast("long").alias("chars"),
                         under_loss.alias("loss"), F.when(F.col("final"), F.col("text")).alias("whole"))
    joined = narrow.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    read = joined.select("conv_id", "formatted_chars", read_turns(F.col("whole")).alias("turns"),
                         F.array_join(F.col("losses.loss"), "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars")


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose texts hold control strings."""
    probe = turns.sparkSession.createDataFrame(
        [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", ASSISTANT))],
        "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role",
                        "text").unionAll(probe)


def _escaped_sql(text: str) -> str:
    doubled = f"replace({text}, '\\', '\\\\')"
    return reduce(lambda t, c: f"replace({t}, '{c}', '{c[0]}\\{c[1:]}')", CONTROL, doubled)


#: What the digests are, in SQL; lengths of examples are running sums over turns.
DIGESTS_SQL = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(START + ROLE + TEXT + END)} AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM every),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
