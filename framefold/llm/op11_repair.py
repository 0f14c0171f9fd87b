"""Conversation structure repair by a rank-convergent parallel Viterbi search.

The cheapest edits that give role initials ``(s?(ua)+)?`` are a shortest path through four states (nothing yet,
after s, after u, after a). Conversations are cut into chunks of ``CHUNK`` turns, one short string of
turn symbols each, so a conversation of any length is spread over tasks:

* every chunk runs backward from a speculative cost vector (all equal; the last chunk knows its true one);
* fix-up passes hand each chunk the vector that the chunk after it starts with and rerun it where
  that differs by more than a constant from the one it used, until no chunk changes. A constant moves all costs of
  a chunk alike, so the sum of the chunks' constants stitches the costs together;
* with its true costs each chunk traces the least audit from all four entry states; a scan over the chunks'
  entry-to-exit maps, in groups of ``FAN``, picks the one that is entered.

The trace takes, at each step, the first letter in ASCII order that keeps the cost least: D(elete), I(nsert), K(eep), R(erole).

Defined results: turns come by number, nulls first, then role, then a hash of role and text; null role, text, conversation
or turn count as one space where they are text; rows without conversation form one conversation; only
the first letter of a role counts; repeated rows are duplicates after the first; empty tables give no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.ordered import numbered
from framefold.llm.scratch import drop_stored, stored, table

CHUNK, FAN = 64, 64
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACES = " \t\n\x0b\x0c\r"
#: A symbol is 'a' + place of the initial in INITIALS + 4 * fault (0 none, 1 truncated, 2 to be deleted).
INITIALS, SYMBOLS = "suao", "abcdefghijkl"
#: State after a user or assistant turn that fits, and after keeping an initial (-1: it does not fit).
FITS = np.array([2, 2, 3, 2])
KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
FINAL, SPECULATIVE = [0, 10, 5, 0], [0, 0, 0, 0]
FAR = 1 << 20


def _inserted(v: np.ndarray) -> np.ndarray:
    """Costs when turns may be inserted first."""
    a, b = np.minimum(v[:, 2], INSERT + v[:, 3]), np.minimum(v[:, 3], INSERT + v[:, 2])
    return np.stack([np.minimum(v[:, 0], INSERT + a), np.minimum(v[:, 1], INSERT + a), a, b], axis=1)


def backward(symbols: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[place, chunk, state]: cost of the rest of each chunk from each place, given the costs at its end."""
    n, length = symbols.shape
    out = np.empty((length + 1, n, 4), np.int64)
    out[length] = end
    for i in range(length - 1, -1, -1):
        after, initial, fault = out[i + 1], symbols[:, i] % 4, symbols[:, i] // 4
        to = KEEP[initial]
        extra = np.where(fault == 1, TRUNCATED, 0)[:, None]
        keep = np.where(to >= 0, extra + np.take_along_axis(after, np.maximum(to, 0), axis=1), FAR)
        edit = np.where(fault[:, None] == 2, FAR, np.minimum(keep, extra + REROLE + after[:, FITS]))
        out[i] = np.where((i < sizes)[:, None], _inserted(np.minimum(edit, DELETE + after)), after)
    return out


def trace(symbols: np.ndarray, sizes: np.ndarray, costs: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least audit, resulting roles and exit state of each chunk from each entry state."""
    n, length = symbols.shape
    row = np.arange(n)[:, None]
    at, state = np.zeros((n, 4), np.int64), np.tile(np.arange(4), (n, 1))
    padded = np.concatenate([symbols, np.full((n, 1), 11, symbols.dtype)], axis=1)
    letters, roles = [], []
    while True:
        now, ended = costs[at, row, state], at >= sizes[:, None]
        active = ~ended | (last[:, None] & (now > 0))
        if not active.any():
            break
        symbol, after = padded[row, at], np.minimum(at + 1, length)
        extra, to = np.where(symbol // 4 == 1, TRUNCATED, 0), KEEP[symbol % 4, state]
        may = ~ended & (symbol // 4 < 2)
        insert = INSERT + costs[at, row, FITS[state]] == now
        delete = ~ended & (DELETE + costs[after, row, state] == now)
        keep = may & (to >= 0) & (extra + costs[after, row, np.maximum(to, 0)] == now)
        letter = np.select([~active, delete, insert, keep], [0, ord("D"), ord("I"), ord("K")], ord("R"))
        fit = np.where(FITS[state] == 3, ord("a"), ord("u"))
        letters.append(letter)
        roles.append(np.select([letter == 0, letter == ord("D"), letter == ord("K")], [0, ord("-"), ord("=")], fit))
        state = np.select([(letter == 0) | (letter == ord("D")), letter == ord("K")], [state, to], FITS[state])
        at = at + (active & (letter != ord("I")))

    def texts(steps: list[np.ndarray]) -> np.ndarray:
        if not steps:
            return np.full((n, 4), "", "U1")
        return np.ascontiguousarray(np.stack(steps, axis=2).astype(np.uint8)).view(f"S{len(steps)}")[:, :, 0].astype(str)
    return texts(letters), texts(roles), state


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = batch.column("symbols").to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    width = int(sizes.max(initial=0))
    symbols = np.frombuffer("".join(t.ljust(width, "l") for t in texts).encode(), np.uint8).reshape(len(texts), width) - ord("a")
    return symbols, sizes, batch.column("end").flatten().to_numpy().astype(np.int64).reshape(-1, 4)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(x) + 1, 4), pa.int32()), pa.array(x.ravel(), kind))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        start = backward(*_read(b))[0]
        least = start.min(axis=1, initial=FAR)
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("conv", "chunk", "symbols", "last", "end")] + [_lists(start - least[:, None], pa.int64()), pa.array(least, pa.int64())],
            ["conv", "chunk", "symbols", "last", "end", "start", "constant"])


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        symbols, sizes, end = _read(b)
        audits, roles, exits = trace(symbols, sizes, backward(symbols, sizes, end), np.array(b.column("last").to_pylist(), bool))
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), _lists(audits, pa.string()), _lists(roles, pa.string()), _lists(exits, pa.int64())],
                                         ["conv", "chunk", "audits", "roles", "exits"])


def settled(chunks: DataFrame) -> DataFrame:
    """``chunks`` (conv, chunk, symbols, last) with their true ``end`` and ``start`` costs less a ``constant``."""
    spark, kind = chunks.sparkSession, chunks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, chunk long, symbols string, last boolean, end array<long>, start array<long>, constant long"

    def vector(v: list[int]):
        return F.array(*[F.lit(x).cast("long") for x in v])

    first = chunks.withColumn("end", F.when(F.col("last"), vector(FINAL)).otherwise(vector(SPECULATIVE)))
    now = stored(first.select("conv", "chunk", "symbols", "last", "end").mapInArrow(_run, schema), "pass")
    while True:
        after = now.where("chunk > 0").select(F.col("conv").alias("c"), (F.col("chunk") - 1).alias("k"), F.col("start").alias("want"))
        told = now.join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left")
        told = stored(told.select(*now.columns, F.coalesce("want", "end").alias("want")), "told")
        stale = F.col("want") != F.col("end")
        if told.where(stale).isEmpty():
            drop_stored(spark, told)
            return now
        again = told.where(stale).select("conv", "chunk", "symbols", "last", F.col("want").alias("end")).mapInArrow(_run, schema)
        then = stored(told.where(~stale).select(*now.columns).union(again), "pass")
        drop_stored(spark, now)
        drop_stored(spark, told)
        now = then


def entered(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv, chunk, entry): the state in which each chunk is entered, from the chunks' ``exits`` by entry state.

    Chunks are composed in groups of ``fan``, the groups likewise, and entries are handed down again.
    """
    groups = maps.groupBy("conv", F.floor(F.col("chunk") / fan).alias("group")).agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("l"))
    groups = stored(groups, "groups")
    if groups.where("group > 0").isEmpty():
        into = groups.withColumn("entry", F.lit(0).cast("long"))
    else:
        whole = F.aggregate("l", F.array(*[F.lit(q).cast("long") for q in range(4)]), lambda acc, x: F.transform(acc, lambda q: F.get(x["exits"], q.cast("int"))))
        above = entered(groups.select("conv", F.col("group").alias("chunk"), whole.alias("exits")), fan)
        above = above.select(F.col("conv").alias("c"), F.col("chunk").alias("g"), "entry")
        into = groups.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("group") == F.col("g")))
    states = F.aggregate("l", F.array("entry"), lambda acc, x: F.concat(acc, F.array(F.get(x["exits"], F.element_at(acc, -1).cast("int")))))
    return into.select("conv", F.explode(F.arrays_zip(F.col("l.chunk").alias("chunk"), F.slice(states, F.lit(1), F.size("l")).alias("entry"))).alias("x")).select("conv", "x.chunk", "x.entry")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of every conversation, and a report of its faults.

    Edits: (conv_id, chunk, step, edit, role, text), in order by chunk and step; deleted turns keep their
    role and text and have edit D, the rest are the repaired conversation.
    Report: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).
    """
    role_of, text_of = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    given = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), role_of.alias("role"), text_of.alias("text"))
    given = given.withColumn("form", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(shown == "", "blank").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    placed = stored(numbered(given.select("conv", "turn", "role", "form", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial")),
                             "conv", ["turn", "role", "form"]), "placed")
    firsts = placed.groupBy("conv", "form").agg(F.min("at").alias("first")).select(F.col("conv").alias("c"), F.col("first").alias("k"))
    known = placed.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("k")), "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("k").isNull(), "duplicate").otherwise(F.col("fault"))
    level = F.when(fault == "truncated", 1).when(fault.isNotNull(), 2).otherwise(0)
    symbol = F.substring(F.lit(SYMBOLS), F.instr(F.lit(INITIALS), F.col("initial")) + 4 * level, F.lit(1))
    rows = known.select("conv", F.floor(F.col("at") / chunk).alias("chunk"), F.struct((F.col("at") % chunk).alias("slot"), symbol.alias("symbol")).alias("s"), fault.alias("fault"))
    cut = stored(rows.groupBy("conv", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["symbol"]), "").alias("symbols"),  # at most ``chunk`` turns
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]), "chunks")
    after = cut.where("chunk > 0").select(F.col("conv").alias("c"), (F.col("chunk") - 1).alias("k"), F.left("symbols", F.lit(1)).alias("next"))
    linked = stored(cut.join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").drop("c", "k").withColumn("last", F.col("next").isNull()), "linked")
    initials = F.translate(F.concat("symbols", F.coalesce("next", F.lit(""))), SYMBOLS, INITIALS * 3)
    pairs = F.transform(F.split(initials, ""), lambda x, i: F.substring(initials, i + 1, F.lit(2)))
    illegal = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))

    now = settled(linked)
    traced = stored(now.select("conv", "chunk", "symbols", "last", "end").mapInArrow(
        _trace, f"conv {now.schema['conv'].dataType.simpleString()}, chunk long, audits array<string>, roles array<string>, exits array<long>"), "traced")
    entries = entered(traced.select("conv", "chunk", "exits")).select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.col("entry").cast("int").alias("entry"))
    chosen = stored(traced.join(entries, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
                    .select("conv", "chunk", F.get("audits", "entry").alias("audit"), F.get("roles", "entry").alias("roles")), "chosen")

    step = F.explode(F.transform(F.split("audit", ""), lambda e, i: F.struct(i.alias("step"), e.alias("edit"), F.substring("roles", i + 1, F.lit(1)).alias("to"))))
    before = F.substring("audit", F.lit(1), F.col("step"))
    slot = F.col("step") - (F.length(before) - F.length(F.replace(before, F.lit("I"), F.lit(""))))
    steps = chosen.where("audit <> ''").select("conv", "chunk", "audit", step.alias("e")).select("conv", "chunk", "audit", "e.*").where("edit <> ''")
    steps = steps.select("conv", "chunk", "step", "edit", "to", F.when(F.col("edit") != "I", F.col("chunk") * chunk + slot).alias("place"))
    names = placed.select(F.col("conv").alias("c"), "at", "turn", "form")
    named = steps.join(names, F.col("conv").eqNullSafe(F.col("c")) & (F.col("place") == F.col("at")), "left").drop("c", "at")
    texts = given.groupBy("conv", "turn", "form").agg(F.first("role").alias("role"), F.first("text").alias("text")).select(
        F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("form").alias("f"), "role", "text")
    whole = named.join(texts, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("form") == F.col("f")), "left")
    edits = whole.select(F.col("conv").alias(conv_id), "chunk", "step", "edit",
                         F.when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant").otherwise(F.col("role")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))

    faults = linked.select("conv", "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal")).groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    costs = now.groupBy("conv").agg((F.sum("constant") + F.sum(F.when(F.col("chunk") == 0, F.get("start", F.lit(0))).otherwise(0))).alias("cost"))
    audits = chosen.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    span = placed.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    report = span
    for part in (faults, costs, audits):
        report = report.join(part.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return edits, report.withColumnRenamed("conv", conv_id)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32(conv_id:turn) % 20: dropped, emptied, without stops, repeated, or as user."""
    def text_of(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), key.alias("key")).where("key <> 0")
    text = F.when(F.col("key") == 1, F.lit("")).when(F.col("key") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("key") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("key") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired: faults, cost, audit and a digest of what results."""
    given = table(spark, sf_dir, "conversations")
    edits, report = repair(damaged(given))
    # The digest covers the whole conversation, so its lines come together in one row.
    lines = edits.where("edit <> 'D'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "step", F.concat("role", F.lit(":"), "text").alias("line")))).alias("l"))
    digests = lines.select(F.col("conv_id").alias("c"), F.sha2(F.array_join(F.col("l.line"), "\n"), 256).alias("sha"))
    out = given.select("conv_id").distinct()
    out = out.join(report.withColumnRenamed("conv_id", "r"), F.col("conv_id").eqNullSafe(F.col("r")), "left")
    out = out.join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op11_repair": op11_repair}


def _sql() -> str:
    from framefold.llm.op12_prefix_trie import SQL_CRC32

    def cost(extra: str, letter: str, rest: str) -> str:
        return f"lpad(CAST(CAST(left({rest}, 9) AS INT) + {extra} AS VARCHAR), 9, '0') || '{letter}' || substr({rest}, 10)"

    def step(q: int, fit: int, keeps: dict[str, int]) -> str:
        kept = " ".join(f"WHEN NOT forced AND initial = '{i}' THEN {cost('extra', 'K', f'v{to}')}" for i, to in keeps.items())
        return f"least({cost('2', 'D', f'v{q}')}, CASE {kept} END, CASE WHEN NOT forced THEN {cost('1 + extra', 'R', f'v{fit}')} END) AS b{q}"

    bases = ", ".join([step(0, 2, {"s": 1, "u": 2}), step(1, 2, {"u": 2}), step(2, 3, {"a": 3}), step(3, 2, {"u": 2})])
    crc = SQL_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
damaged AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM keyed, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS t(copy) WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM damaged),
placed AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
                  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
                  lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM numbered),
symbols AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS forced, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM placed),
sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
best AS (SELECT conv_id, n AS i, '000000000' AS v0, '000000010II' AS v1, '000000005I' AS v2, '000000000' AS v3 FROM sizes
  UNION ALL SELECT conv_id, i, least(b0, {cost("5", "I", "w2")}), least(b1, {cost("5", "I", "w2")}), w2, w3
  FROM (SELECT *, least(b2, {cost("5", "I", "b3")}) AS w2, least(b3, {cost("5", "I", "b2")}) AS w3
        FROM (SELECT b.conv_id, b.i - 1 AS i, {bases} FROM best b JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.pos = b.i - 1))),
audits AS (SELECT conv_id, CAST(left(v0, 9) AS BIGINT) AS cost, substr(v0, 10) AS audit FROM best WHERE i = 0),
walk AS (SELECT conv_id, audit, 0 AS j, 0 AS i, 0 AS q, CAST([] AS VARCHAR[]) AS lines FROM audits
  UNION ALL SELECT w.conv_id, audit, j + 1, CASE WHEN substr(audit, j + 1, 1) = 'I' THEN i ELSE i + 1 END,
    CASE substr(audit, j + 1, 1) WHEN 'D' THEN q WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE q WHEN 2 THEN 3 ELSE 2 END END,
    CASE substr(audit, j + 1, 1) WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE substr(audit, j + 1, 1) WHEN 'I' THEN '' ELSE text END) END
  FROM walk w LEFT JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.i WHERE j < length(audit)),
repaired AS (SELECT conv_id, array_to_string(lines, chr(10)) AS lines FROM walk WHERE j = length(audit)),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                  count(*) FILTER (WHERE next IS NOT NULL AND left(role, 1) || next NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE: dict[str, str] = {"op11_repair": _sql()}
