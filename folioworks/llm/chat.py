"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as ``[INST]role[/INST]text</s>``; a backslash before control
strings (and before backslashes) inside roles and texts makes them plain text and is
taken out again when read.  Prefix sums of the turns' tokens choose turn-aligned
windows: the token line of a conversation is cut into cells of one budget, a window
is the turns that lie inside a cell, and a turn that reaches over a cell's end is a
window of its own.  Each window repeats the system turn and, before its new turns,
as many earlier turns as a history budget allows.  Only texts of new assistant turns
are in the loss mask, so every one of them is a target once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Tokens of new turns in a window, and of repeated turns before them. A turn counts its words and four for its marks.
BUDGET, HISTORY, MARKS = 768, 192, 4
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, n_repeated, n_new, loss (spans of code points: start, length).

    turns: conv_id, turn, role, text; a null role or text is an empty one.  Turns are in
    order of turn, role, text (nulls first), so repeated rows are turns of their own.
    The first turn, if its role is system, is repeated in every window but its own.
    Windows hold at most `budget` tokens of new turns unless a single turn has more, and
    at most `history` tokens of earlier ones; rows without conv_id are one conversation.
    The prefix sums need a conversation's turns in one partition, in order, so one
    conversation (and so all rows without conv_id) is one task's; an empty table gives an
    empty result; other columns are ignored.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit("[INST]"), escaped(F.col("role")), F.lit("[/INST]"))
    body = escaped(F.col("text"))
    t = t.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"), (F.regexp_count("text", F.lit(r"\S+")) + MARKS).cast("long").alias("tokens"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"nth": F.row_number().over(order), "end": F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0))})
    t = t.withColumn("begin", F.col("end") - F.col("tokens"))
    cell = F.floor(F.col("begin") / budget).cast("long")
    t = t.withColumn("window", cell * 2 + (F.col("end") > (cell + 1) * budget).cast("long"))
    t = t.withColumns({"piece": F.concat("head", "body", F.lit("</s>")), "is_system": (F.col("nth") == 1) & (F.col("role") == "system")})
    by_token = W.partitionBy("conv_id").orderBy("begin")
    # of a window's first turn: the turns that lie wholly in the history budget before it
    earlier = F.collect_list(F.when(~F.col("is_system"), F.struct("begin", "piece"))).over(by_token.rangeBetween(-history, -1))
    system = F.max(F.when(F.col("is_system"), F.col("piece"))).over(W.partitionBy("conv_id"))
    in_window = W.partitionBy("conv_id", "window").orderBy("begin")
    t = t.withColumn("lead", F.row_number().over(in_window) == 1)
    t = t.withColumns({"earlier": F.when(F.col("lead"), F.transform(earlier, lambda e: e["piece"])), "system": F.when(F.col("lead") & ~F.col("is_system"), system)})
    t = t.withColumn("context", F.when(F.col("lead"), F.concat(F.when(F.col("system").isNull(), F.array().cast("array<string>")).otherwise(F.array("system")), "earlier")))
    t = t.withColumn("before", F.coalesce(F.sum(F.length("piece")).over(in_window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("before") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    rows = t.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("nth", "piece"))).alias("new"),
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.first("context", ignorenulls=True).alias("context"),
    )
    shift = F.length(F.array_join("context", "")).cast("long")
    return rows.select(
        "conv_id",
        "window",
        F.concat(F.array_join("context", ""), F.array_join(F.transform("new", lambda e: e["piece"]), "")).alias("text"),
        F.size("context").alias("n_repeated"),
        F.size("new").alias("n_new"),
        F.transform("spans", lambda s: F.struct((s["start"] + shift).alias("start"), s["length"].alias("length"))).alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the new turns, unescaped) and targets (texts under the loss mask), from the windows' texts."""
    pieces = F.slice(F.split("text", "</s>"), F.col("n_repeated") + 1, F.col("n_new"))
    turn = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, r"(?s)^\[INST\](.*?)\[/INST\]", 1)).alias("role"),
            unescaped(F.regexp_extract(p, r"(?s)^\[INST\].*?\[/INST\](.*)$", 1)).alias("text"),
        ),
    )
    under = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", turn.alias("turns"), under.alias("targets"), F.length("text").cast("long").alias("chars"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    read = read_turns(format_chats(turns))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = read.select("conv_id", "window", F.size("turns").cast("long").alias("n"), every.alias("all"), F.array_join("targets", "").alias("target"), "chars")
    conv = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "all", "target"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    whole = F.array_join(F.transform("w", lambda e: e["all"]), "")
    target = F.array_join(F.transform("w", lambda e: e["target"]), "")
    return conv.select("conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")


#: The same from the plain turns, with the length of every window's text.
OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(replace(role, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'))
      + length(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')) + 17 AS chars,
    len(regexp_extract_all(text, '[^\\s\\x0b]+')) + {MARKS} AS tokens
  FROM t
), p AS (
  SELECT *, row_number() OVER o AS nth, sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS b FROM e
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, 2 * (b // {BUDGET}) + (b + tokens > (b // {BUDGET} + 1) * {BUDGET})::INT AS win, nth = 1 AND role = 'system' AS is_system FROM p
), h AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, win ORDER BY b) = 1 AS lead,
    coalesce(sum(CASE WHEN is_system THEN 0 ELSE chars END) OVER (PARTITION BY conv_id ORDER BY b RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING), 0)
      + CASE WHEN is_system THEN 0 ELSE coalesce(max(CASE WHEN is_system THEN chars END) OVER (PARTITION BY conv_id), 0) END AS context
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '')) AS loss_sha256,
  sum(chars + CASE WHEN lead THEN context ELSE 0 END)::BIGINT AS formatted_chars
FROM h GROUP BY conv_id
"""
