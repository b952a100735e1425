"""Chat formatting in budgeted windows, in DataFrame operations only.

Turns stay rows. They are sorted by ranges of (conversation, turn), so a conversation of any
length is spread over tasks, and prefix sums of the turns' tokens are taken in two steps: within
a conversation's part of a task, and over its parts. The sums choose the windows: turns whose
sums end in the same stride belong together. A stride is seven eighths of a window's room, so
the turn that reaches over a stride's edge still fits; if it reaches further back, it is a
window of its own. Nothing is decided turn after turn, so the work grows with the turns.

Every window begins with the conversation's system turn and repeats some of the turns before it
(at most ``history``, of ``history_budget`` tokens, for which room is kept). Turns shown again
are marked and carry no loss, so over all windows each assistant text is a target once. Only
the turns of one window are put together in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch
from driftgate.operators.skew import heavy_keys, join_one

#: The template's control strings. "<|" never occurs in an escaped text.
START, END, REPEAT, NEWLINE = "<|im_start|>", "<|im_end|>", "<|repeat|>", "<|nl|>"
BUDGET, HISTORY, HISTORY_BUDGET = 1024, 2, 256


def escape(c: Column) -> Column:
    """In "<", any number of backslashes and "|" there is one backslash more afterwards."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def tokens(c: Column) -> Column:
    """An estimate from the text: one token for every four characters begun, and four for the
    turn's marks."""
    return (F.ceil(F.length(c) / 4) + 4).cast("long")


def _placed(conversations: DataFrame, conv: str, turn: str, role: str, text: str, scratch: Scratch) -> DataFrame:
    """Turns with a conversation key ``c`` that is never null, their ``place`` in it (from 1),
    their tokens and the tokens up to and with them."""
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.when(F.col(conv).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(conv).cast("string")))
    order = ["c", "turn", "role", "text"]
    t = conversations.select(key.alias("c"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                             F.coalesce(F.col(text), F.lit("")).alias("text"))
    laid = t.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "c", "conv_id", "role", "text", tokens(F.col("text")).alias("tokens"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    laid = scratch.write(laid)
    parts = laid.groupBy("c", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sum"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("c", "part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("rows", "sum")])
    within = Window.partitionBy("c", "part").orderBy("at")
    upto = F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("sum_before")
    return laid.join(parts, ["c", "part"]).select("c", "conv_id", "role", "text", "tokens", (F.row_number().over(within) + F.col("rows_before")).alias("place"),
                                                  upto.alias("upto"))


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET,
                 conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, window, formatted, loss): the windows of every conversation; ``window`` is the
    number of turns before its first new one (0 for the first, so they are in order), ``loss`` an
    array of (start, length) in characters of ``formatted``, one for each target.

    A null role or text counts as empty. A turn larger than the budget is a window of its own,
    whole. Turns that repeat a turn number are ordered by role and text. Rows without a
    conversation id form one conversation. An empty table gives no rows.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    turns = scratch.write(_placed(conversations, conv, turn, role, text, scratch))
    heavy = heavy_keys(turns, "c")
    system = turns.filter("place = 1 and role = 'system'").select("c", "conv_id", "role", "text", F.col("tokens").alias("kept"))
    new = join_one(turns, system.select("c", "kept"), "c", heavy).withColumn("sys", F.col("kept").isNotNull().cast("int")).filter("place > sys")
    new = new.withColumn("kept", F.coalesce("kept", F.lit(0)))
    room = F.greatest(F.lit(budget) - F.col("kept") - history_budget, F.lit(1))
    stride = F.greatest(F.floor(room * 7 / 8), F.lit(1))
    new = new.withColumn("room", room).withColumn("bucket", F.floor((F.col("upto") - F.col("kept") - 1) / stride))
    sums = new.groupBy("c", "bucket").agg(F.sum("tokens").alias("total"), F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    apart = (F.col("total") > F.col("room")) & (F.col("rows") > 1) & (F.col("place") > F.col("first"))
    new = new.join(sums, ["c", "bucket"]).withColumn("from", F.when(apart, F.col("first") + 1).otherwise(F.col("first")))
    new = scratch.write(new.select("c", "conv_id", "role", "text", "tokens", "place", "upto", "sys", "from"))
    heads = new.filter("place = from").select("c", "conv_id", "from", "sys", (F.col("upto") - F.col("tokens")).alias("base"))
    cols = ["c", "conv_id", "from", "place", "role", "text", "old"]
    wanted = heads.select("c", "from", "sys", "base", F.explode(F.sequence(F.lit(1), F.lit(history))).alias("h")) if history else heads.limit(0).withColumn("h", F.lit(0))
    wanted = wanted.withColumn("place", F.col("from") - F.col("h")).filter("place > sys")
    again = wanted.join(turns, ["c", "place"]).filter(F.col("base") - F.col("upto") + F.col("tokens") <= history_budget).withColumn("old", F.lit(True))
    # The system turn stands in every window; a conversation of nothing else is one window.
    said = system.select("c", F.lit(1).cast("long").alias("place"), "role", "text")
    always = join_one(heads, said, "c", heavy).filter("place is not null").withColumn("old", F.col("from") > F.col("sys") + 1)
    alone = system.join(heads.select("c").distinct(), "c", "left_anti").select(
        "c", "conv_id", F.lit(2).alias("from"), F.lit(1).alias("place"), "role", "text", F.lit(False).alias("old"))
    shown = new.withColumn("old", F.lit(False)).select(cols).union(again.select(cols)).union(always.select(cols)).union(alone.select(cols))
    first = F.col("from") - 1 == F.col("sys")
    firsts = heads.filter(first).select("c", "from").union(alone.select("c", "from")).withColumn("one", F.lit(True))
    mark = F.concat(F.lit(START), F.when(F.col("old"), F.lit(REPEAT)).otherwise(F.lit("")), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    shown = shown.select("c", "conv_id", "from", F.struct("place", mark.alias("head"), escape(F.col("text")).alias("body"),
                                                          (~F.col("old") & (F.col("role") == "assistant")).alias("target")).alias("part"))
    w = shown.groupBy("c", "conv_id", "from").agg(F.array_sort(F.collect_list("part")).alias("parts")).join(firsts, ["c", "from"], "left")
    w = w.select("conv_id", F.when(F.col("one"), 0).otherwise(F.col("from") - 1).cast("long").alias("window"), "parts")
    nothing = F.array().cast("array<struct<start:int,length:int>>")
    loss = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).alias("at"),
            F.concat(acc["spans"], F.when(p["target"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))).otherwise(nothing)).alias("spans")),
        lambda acc: acc["spans"])
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return w.select("conv_id", "window", formatted.alias("formatted"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, targets, formatted_chars), read back from the formatted text and the
    loss mask: the turns (role, text) that are shown for the first time, and the texts under
    the mask, both unescaped and in order."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    pieces = F.filter(pieces, lambda p: ~p.startswith(REPEAT))
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - 2 - len(END))
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.replace(head(p), F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body(p)).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    w = windows.select("conv_id", F.struct("window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return g.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
                    F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"),
                    F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"))
