"""Conversation prefix trie: one SQL ROLLUP over positional turn columns aggregates all prefixes together.

A turn is named by 128 hash bits of its position, role and text (64-bit halves ``a`` and ``b``); a prefix by the exclusive or of
its turns' names. Conversations are cut into blocks of ``WIDTH`` turns, a row each: the name
of the prefix before the block and one column per turn. ``GROUP BY block, prior, ROLLUP(t1, ..., tW)``
counts every prefix that ends in the block, ``grouping_id()`` tells how many turns it has there, and long
conversations simply have rows in further blocks, keyed by the node that the block before ended in. No
rounds over depth: all blocks are aggregated in one job, and partial aggregation collapses a common
first turn before the shuffle.

Subtree sums take a second ROLLUP. A node belongs to its smallest member; a conversation then owns the lower
end of its path. The sum over the subtree of a node is what all its members own in total, less what
its smallest member owns above the node, a running sum along one conversation.

Defined results: null role or text is empty; null turn numbers come first; turns with equal numbers are
ordered by role, then by a hash of the text; repeated rows are turns of their own; rows without conversation are left out
(no member could name their nodes); an empty table has no nodes, not even a root; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.ordered import numbered
from framefold.llm.scratch import stored, table

WIDTH = 8
FAMILY, MOST_SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, id, words) per turn: place in its conversation, digest of role and text, words of the text."""
    role_of, text_of = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    named = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), role_of.alias("role"),
        F.md5(F.concat(F.length(role_of).cast("string"), F.lit(":"), role_of, text_of)).alias("id"),
        F.regexp_count(text_of, F.lit(WORD)).cast("long").alias("words"))
    return numbered(named, "conv", ["turn", "role", "id"]).select("conv", "at", "id", "words")


def shared_openings(turns: DataFrame) -> DataFrame:
    """The turns of every conversation c with its first h replaced by those of conversation c - c % 20, h = crc32(c) % 4."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED
    base = F.col("conv") - F.col("conv") % FAMILY
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("at") < MOST_SHARED - 1)).select(F.col("conv").alias("base"), "at", "id", "words")
    borrowed = turns.select("conv").distinct().withColumns({"base": base, "h": h}).join(heads, "base").where("at < h")
    parts = borrowed.select("conv", F.lit(0).alias("part"), F.col("at").alias("place"), "id", "words").union(
        turns.where(F.col("at") >= h).select("conv", F.lit(1), "at", "id", "words"))
    return numbered(parts, "conv", ["part", "place"]).select("conv", "at", "id", "words")


def _blocks(turns: DataFrame, conversations: DataFrame, width: int) -> DataFrame:
    """(conv, block, prior_a, prior_b, xa, xb, t1..tW): a row for each block of each conversation, one without turns for the others."""
    named = turns.select("conv", F.floor(F.col("at") / width).alias("block"), F.struct(
        (F.col("at") % width).alias("slot"), F.xxhash64("at", "id").alias("a"), F.xxhash64("id", "at", F.lit(12)).alias("b"), "words").alias("t"))
    rows = named.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"),  # at most ``width`` turns
                                              F.bit_xor("t.a").alias("xa"), F.bit_xor("t.b").alias("xb"))
    turnless = conversations.join(turns.select("conv").distinct(), "conv", "left_anti")
    none = F.lit(0).cast("long")
    slots = [F.when(s.isNotNull(), F.struct(s["a"].alias("a"), s["b"].alias("b"), s["words"].alias("words"))).alias(f"t{i + 1}")
             for i, s in enumerate(F.get("ts", F.lit(i)) for i in range(width))]
    given = rows.unionByName(turnless.select("conv", none.alias("block"), F.lit(None).cast(rows.schema["ts"].dataType).alias("ts"), none.alias("xa"), none.alias("xb")))
    return numbered(given, "conv", ["block"], xors={"prior_a": "xa", "prior_b": "xb"}).select("conv", "block", "prior_a", "prior_b", "xa", "xb", *slots)


def _rolled(blocks: DataFrame, width: int, measures: str) -> DataFrame:
    """The ``measures`` of every prefix: (depth, a, b, pa, pb, words, ...), the parent's name in pa and pb."""
    slots = [f"t{i + 1}" for i in range(width)]
    grouped = blocks.sparkSession.sql(
        f"SELECT block, prior_a, prior_b, {', '.join(slots)}, {width} - bit_count(grouping_id()) AS inside, {measures} "
        f"FROM {{blocks}} GROUP BY block, prior_a, prior_b, ROLLUP({', '.join(slots)})", blocks=blocks)
    held = sum((F.col(s).isNotNull().cast("int") for s in slots[1:]), F.col(slots[0]).isNotNull().cast("int"))
    real = grouped.where((held == F.col("inside")) & ((F.col("inside") > 0) | (F.col("block") == 0)))
    last = F.get(F.array(*slots), F.col("inside").cast("int") - 1)

    def name(half: str) -> Column:
        out = F.col(f"prior_{half}")
        for s in slots:
            out = out.bitwiseXOR(F.coalesce(F.col(s)[half], F.lit(0).cast("long")))
        return out

    at_root = F.col("inside") == 0
    real = real.withColumns({"a": name("a"), "b": name("b"), "last": F.when(~at_root, last)})
    columns = [c for c in grouped.columns if c not in ("block", "prior_a", "prior_b", "inside", *slots)]
    return real.select((F.col("block") * width + F.col("inside")).cast("long").alias("depth"), "a", "b",
                       F.when(~at_root, F.col("a").bitwiseXOR(F.col("last.a"))).alias("pa"), F.when(~at_root, F.col("b").bitwiseXOR(F.col("last.b"))).alias("pb"),
                       F.coalesce("last.words", F.lit(0).cast("long")).alias("words"), *columns)


def prefix_trie(turns: DataFrame, conversations: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``turns`` (conv, at, id, words), and where each of ``conversations`` (conv) ends.

    Nodes: (a, b, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens).
    Ends: (conv, a, b), the node of the whole conversation.
    """
    blocks = stored(_blocks(turns, conversations.select("conv").distinct(), width), "blocks")
    nodes = stored(_rolled(blocks, width, "count(*) AS n_convs, min(conv) AS conv_id"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    owned = nodes.join(children, ["a", "b"], "left").select(
        *nodes.columns, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    owned = stored(numbered(owned, "conv_id", ["depth"], sums={"above": "saved"}), "owned")
    totals = owned.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")).where("saved > 0 OR leaves > 0")
    below = _rolled(blocks.join(totals, "conv"), width, "sum(saved) AS all_saved, sum(leaves) AS n_leaves").select("a", "b", "all_saved", "n_leaves")
    # Below its top node a conversation owns its whole path, so only top nodes look their parent up.
    tops = owned.where("at = 0").select("a", "b", "pa", "pb")
    up = tops.join(nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("up")), ["pa", "pb"]).select("a", "b", "up")
    found = owned.join(below, ["a", "b"], "left").join(up, ["a", "b"], "left").select(
        "a", "b", "conv_id", "depth", F.when(F.col("at") > 0, F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"), (F.coalesce("all_saved", F.lit(0).cast("long")) - F.col("above")).alias("saved_tokens"))
    return found, blocks.groupBy("conv").agg(F.bit_xor("xa").alias("a"), F.bit_xor("xb").alias("b"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, rebuilt with shared openings."""
    turns = stored(turns_of(table(spark, sf_dir, "conversations")), "turns")
    nodes, ends = prefix_trie(shared_openings(turns), turns.select("conv"))
    # The digest names every member that ends in a node in one text, so that list is one row.
    listed = ends.groupBy("a", "b").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ","), 256).alias("sha"))
    return nodes.join(listed, ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: DuckDB has no crc32: bit steps over the bytes of a decimal number.
SQL_CRC32 = """CAST(xor(list_reduce(list_concat([4294967295], flatten([[CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split({0}, '')])),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) AS BIGINT)"""
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE: dict[str, str] = {"op12_prefix_trie": f"""
WITH placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
                       {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {SQL_CRC32.format("CAST(conv_id AS VARCHAR)")} % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (SELECT c.conv_id, 0 AS part, p.pos, p.x FROM c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % {FAMILY} AND p.pos < c.h
            UNION ALL SELECT c.conv_id, 1, p.pos, p.x FROM c JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= c.h),
seqs AS (SELECT c.conv_id, coalesce(q, []) AS q FROM c LEFT JOIN (SELECT conv_id, list(x ORDER BY part, pos) AS q FROM rebuilt GROUP BY conv_id) USING (conv_id)),
node AS (SELECT q[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(q) = d), '') AS ends
         FROM seqs, unnest(range(0, len(q) + 1)) AS t(d) GROUP BY ALL),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children,
                     CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].t, '{WORD}')) END AS saved FROM node LEFT JOIN kids USING (p)),
below AS (SELECT p[1:e] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM full_node, unnest(range(0, d + 1)) AS t(e) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN below USING (p) LEFT JOIN node up ON n.d > 0 AND up.p = n.p[1:n.d - 1]"""}
