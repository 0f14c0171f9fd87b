"""Mixing sources to target weights.

Sizes (words) are summed per source. The mix shares ``share`` of all words by weight;
a source's target stops at ``most`` times its size and the excess goes to the others by
weight, until none is above. That fixed point is ``target = min(most * size, level * weight)``;
the level is found by rounds of one distributed aggregate each, of which the driver
sees two sums. A document is emitted floor(rate) times, plus one more with
probability equal to the fraction: rate = target / size of its source, and the draw is a hash of
the seed and the document id, so reruns agree and the order of rows does not matter. Rows without
an id draw on their text.

Sources are numbered in code-point order, null last, and weigh ``weights`` in turn. The
numbering sorts by range and adds up counts per range, so no task holds all sources.
Everything is DataFrame code. The table of sources is joined by its key, and Spark
splits a hot source: rows are (id, source, size), never text.

Defined results: null text has size 0; a null source is a source of its own; an empty
source (size 0) has target 0 and its documents are not taken; rows that share an id share the
draw, as do rows without an id that share a text; an empty table gives an empty mix. The results' column names replace equal ones.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.scratch import stored, table

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix has 3/2 of all words
MOST = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
DRAW_DIGITS = 13  # hex digits: 52 bits, exact in a double


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, total, weight number) per source; ``sizes`` has source and size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    ranged = stored(totals.repartitionByRange(F.col("source").asc_nulls_last())
                    .sortWithinPartitions(F.col("source").asc_nulls_last())
                    .select("source", "total", F.monotonically_increasing_id().alias("at")), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, counts = {}, ranged.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a range
    n = 0
    for r in counts:
        before[r["part"]] = n
        n += r["count"]
    offsets = sizes.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long")
    return ranged.join(offsets, part == F.col("part")).select("source", "total", (place + F.col("before")).alias("number"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the words each source shall have in the mix."""
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = stored(numbered_sources(sizes).select("source", "total", weigh.cast("long").alias("weight")), "sources")
    top, bottom = share
    wide = "decimal(38,0)"
    ceiling = F.col("total").cast("decimal(20,0)") * F.lit(most * bottom)
    whole = int(sources.agg(F.sum(F.col("total").cast(wide))).first()[0] or 0) * top
    # In units of 1/bottom words: level = amount / weight left; a source is full below most * total.
    amount, left = whole, int(sources.agg(F.sum("weight")).first()[0] or 0)
    while left:
        full = ceiling * F.lit(left).cast("decimal(18,0)") <= F.col("weight").cast("decimal(9,0)") * F.lit(str(amount)).cast("decimal(24,0)")
        taken, free = sources.agg(F.sum(F.when(full, ceiling.cast(wide))), F.sum(F.when(~full, F.col("weight")))).first()
        next_amount, next_left = whole - int(taken or 0), int(free or 0)
        if (next_amount, next_left) == (amount, left):
            break
        amount, left = next_amount, next_left
    shared = F.col("weight") * F.lit(float(amount)) / F.lit(float(max(left, 1))) / F.lit(float(bottom))
    capped = (F.col("total") * most).cast("double")
    return sources.select("source", F.col("total").alias("source_size"),
                          (F.least(shared, capped) if left else capped).alias("target"))


def draw(seed: str, doc_id: str, text: str) -> Column:
    """Uniform in [0, 1) from a hash of the seed and the id; without an id, of the seed and the text."""
    unnamed = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), unnamed)))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** DRAW_DIGITS))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """Every document with size, source_size, target and copies (how often the mix has it)."""
    sizes = stored(docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), size_of(text).alias("size"),
                               draw(seed, doc_id, text).alias("draw")), "sizes")
    plan = targets(sizes, **how)
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(float(how.get("most", MOST))))
    taken = F.when(F.col("source_size") > 0, F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("int")).otherwise(0)
    return (sizes.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .select(F.col("doc").alias(doc_id), "source", "size", "source_size", "target", taken.cast("long").alias("copies")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mix itself: ``docs`` with each row repeated as often as it is taken.

    The table of targets is one row a source; every document's rate follows from its own
    row and its source's, so texts are not shuffled by document.
    """
    sizes = docs.select(F.col(source).alias("source"), size_of(text).alias("size"))
    plan = targets(stored(sizes.groupBy("source").agg(F.sum("size").alias("size")), "sizes"), **how)
    rates = plan.select(F.col("source").alias("__of"), F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(how.get("most", MOST))))).otherwise(0.0).alias("__rate"))
    times = F.floor("__rate") + (draw(seed, doc_id, text) < F.col("__rate") - F.floor("__rate")).cast("int")
    return (docs.join(rates, F.col(source).eqNullSafe(F.col("__of")))
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
            .select(*docs.columns))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, size, source_size, target, taken, copies."""
    docs = table(spark, sf_dir, "documents")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


QUERIES = {"op1_mix": op1_mix}
ORACLE = {
    "op1_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT source, total, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, coalesce(sum(4 * total) OVER f, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS free, 3 * sum(total) OVER () AS whole
      FROM w WINDOW f AS (ORDER BY 4.0 * total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT whole - filled AS amount, free FROM o WHERE 4 * total * free > weight * (whole - filled) ORDER BY filled, free DESC LIMIT 1),
t AS (SELECT source, total, least(CAST(weight AS DOUBLE) * CAST(amount AS DOUBLE) / CAST(free AS DOUBLE) / 2.0, CAST(2 * total AS DOUBLE)) AS target FROM w, l),
r AS (SELECT doc_id, size, total, target, least(target / total, 2.0) AS rate,
             CAST(CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM r)
SELECT doc_id, size, total AS source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
""",
}
