"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are numbered and their tokens summed per conversation in two levels (inside range
partitions, then over the partitions' totals), so a conversation of any length is
spread over tasks. With ``room = budget - system turn - history``, a turn that lies in one
stretch of ``room`` tokens of the prefix sum joins the window of that stretch, and a turn that
crosses a boundary is a window of its own: windows are turn-aligned, cover every turn once, and
hold at most ``room`` new tokens unless a single turn is longer. Every window repeats the
system turn and up to ``HISTORY_TURNS`` earlier turns within the history budget; repeated
turns carry no loss, so each assistant text is a target once.

Template: ``[TURN role]\\n`` text ``[END]``. In texts and roles ``~`` becomes ``~0`` and ``[``
becomes ``~1`` (in roles also ``]``: ``~2``), so no control string can appear inside a
text and the escape is reversible.

A turn's tokens are its words plus ``TURN_TOKENS`` for the marks.

Defined results: null text or role is empty; rows without conversation form one conversation;
turns with equal numbers are ordered by role, then text; null turn numbers come first; repeated
rows are turns of their own; only a first turn with role ``system`` is repeated; an
empty table gives no windows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framefold.llm.scratch import stored, table

BUDGET = 768
HISTORY_TOKENS = 192
HISTORY_TURNS = 2
TURN_TOKENS = 4
OPEN, CLOSE, END = "[TURN ", "]\n", "[END]"
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("["), F.lit("~1"))
    return F.replace(out, F.lit("]"), F.lit("~2")) if role else out


def unescape(c: Column) -> Column:
    for mark, plain in (("~2", "]"), ("~1", "["), ("~0", "~")):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with ``at`` (place in the conversation) and ``before`` (tokens of earlier turns, a first system turn left out)."""
    order = ["conv", "turn", "role", "text"]
    ranged = stored(turns.repartitionByRange("conv", "turn").sortWithinPartitions(*order)
                    .withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "turns")
    here = Window.partitionBy("conv", "part").orderBy("row")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    local = (ranged.withColumn("local_at", F.row_number().over(here) - 1)
             .withColumn("local_before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))))
    totals = ranged.groupBy("conv", "part").agg(F.count("*").alias("turns"), F.sum("tokens").alias("spent"),
                                                F.min_by(F.struct("role", "tokens"), "row").alias("first"))
    parts = Window.partitionBy("conv").orderBy("part")  # a row for each range partition that the conversation spans
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("conv").alias("c"), F.col("part").alias("p"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("spent").over(before), F.lit(0)).alias("spent_before"),
        F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head"))
    system = F.when(F.col("head.role") == "system", F.col("head.tokens")).otherwise(0)
    return (local.join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
            .select("conv", "role", "text", "tokens", system.cast("long").alias("system"),
                    (F.col("local_at") + F.col("turns_before")).cast("long").alias("at"),
                    (F.col("local_before") + F.col("spent_before") - system).alias("before")))


def windows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, first_turn, n_repeated, n_tokens, formatted, loss_spans.

    ``loss_spans`` are [start, end) code points of ``formatted``: the new assistant texts.
    """
    text_of, role_of = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    turns = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), role_of.alias("role"), text_of.alias("text"),
                                 (F.regexp_count(text_of, F.lit(r"[^\x20\x09-\x0D]+")) + TURN_TOKENS).cast("long").alias("tokens"))
    known = stored(numbered(turns), "numbered")
    is_system = (F.col("system") > 0) & (F.col("at") == 0)
    room = F.greatest(F.lit(budget - history_tokens) - F.col("system"), F.lit(1))
    fresh = known.where(~is_system).select("conv", "at", "role", "text", "tokens", "before",
                                           F.floor(F.col("before") / room).alias("lo"), F.floor((F.col("before") + F.col("tokens") - 1) / room).alias("hi"))
    opened = fresh.groupBy("conv", "lo", "hi").agg(F.min("at").alias("start"), F.min("before").alias("spent"))
    keys = opened.select(F.col("conv").alias("c"), F.col("lo"), F.col("hi"), "start", "spent")
    wanted = keys.select("c", "lo", "hi", "spent", F.explode(F.sequence(F.col("start") - history_turns, F.col("start") - 1)).alias("place")).where("place >= 0") if history_turns else None
    columns = ["conv", "lo", "hi", "at", "role", "text", "tokens", "new"]
    rows = fresh.withColumn("new", F.lit(True)).select(*columns)
    if wanted is not None:
        again = (known.where(~is_system).join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("place")))
                 .where(F.col("spent") - F.col("before") <= history_tokens).withColumn("new", F.lit(False)))
        rows = rows.union(again.select(*columns))
    first = (known.where(is_system).join(keys, F.col("conv").eqNullSafe(F.col("c")), "left")
             .withColumn("new", F.coalesce(F.col("spent") == 0, F.lit(True)))
             .select("conv", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi"), "at", "role", "text", "tokens", "new"))
    rows = rows.union(first)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(CLOSE))
    body = escape(F.col("text"))
    ahead = Window.partitionBy("conv", "lo", "hi").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (rows.withColumn("head", head).withColumn("body", body).withColumn("piece", F.concat("head", "body", F.lit(END)))
              .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(ahead), F.lit(0)) + F.length("head")))
    target = F.when(F.col("new") & (F.col("role") == "assistant"), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.length("body")).cast("long").alias("end")))
    made = pieces.groupBy("conv", "lo", "hi").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"), F.sort_array(F.collect_list(target)).alias("loss_spans"),
        F.sum((~F.col("new")).cast("int")).cast("int").alias("n_repeated"), F.sum("tokens").alias("n_tokens"),
        F.min(F.when(F.col("new"), F.col("at"))).alias("first_turn"))
    return made.select(F.col("conv").alias(conv_id), "first_turn", "n_repeated", "n_tokens",
                       F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "loss_spans")


def read_back(made: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, first_turn, turns, loss): new turns and unescaped targets, read from the formatted text."""
    parts = F.slice(F.split("formatted", r"\[TURN ", -1), F.col("n_repeated") + 2, F.length("formatted") + 1)
    role = lambda e: F.substring_index(e, CLOSE, 1)
    turns = F.transform(parts, lambda e: F.struct(
        unescape(role(e)).alias("role"),
        unescape(F.substring(e, F.length(role(e)) + len(CLOSE) + 1, F.length(e) - F.length(role(e)) - len(CLOSE) - len(END))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return made.select(conv_id, "first_turn", "formatted", turns.alias("turns"), loss.alias("loss"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1: digests of what is read back from the windows."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL_TEXT}'), (-1L, 1L, 'assistant', '{CONTROL_TEXT}') AS t(conv_id, turn, role, text)")
    back = read_back(windows(given.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
                        F.struct("first_turn", lines.alias("lines"), F.array_join("loss", "").alias("loss")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("p"))
    loss = F.array_join(F.transform("p", lambda x: x["loss"]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long"),
                        F.sha2(F.array_join(F.transform("p", lambda x: x["lines"]), ""), 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                        F.col("formatted_chars").cast("long").alias("formatted_chars"))


QUERIES = {"op5_chat": op5_chat}
ORACLE: dict[str, str] = {}
