"""Benchmark decontamination by winnowing, with DataFrame functions only.

A span of ``n`` words (``SPAN``, or all words of a shorter item) has ``n - k + 1`` grams of ``k = ceil(n / 2)``
words; its fingerprint is the smallest of their hashes. Sliding the span along a text gives one fingerprint
per start, and neighbouring starts that share a minimum are one run, stored once. Equal spans have equal
fingerprints, so every shared span is found: runs of documents are joined with the fingerprints of the
items, and a hit is extended to all starts of its run, whose words are then compared with the items'
spans in full. What is left after that comparison is exact.

Items are named through sets: windows of the same items share one set, and a document refers to the union of
the sets of its windows, so a phrase that most items hold is not listed once per document and item.

Defined results: a null or wordless text has no words and no hit; a null item text or a wordless
item has no window; an item without id counts for hit words but is not listed; repeated rows of
documents each get the same result; repeated item ids are listed once; an empty benchmark hits nothing,
empty documents give no rows; other columns are ignored. Memory follows the longest single text.
"""
from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.scratch import stored, table

SPAN = 10
#: A table of fingerprints or windows with at most so many rows (about 64 MB) is broadcast, a larger one joined by key in SALTS parts.
BROADCAST_ROWS = 1 << 19
SALTS = 16
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(plain, SEPARATOR, -1), "")


def _sliding(values: Column, width: int, of: Callable[..., Column]) -> Column:
    """``of`` the ``width`` neighbours from each place on."""
    if width == 1:
        return values
    return F.transform(F.slice(values, F.lit(1), F.greatest(F.size(values) - (width - 1), F.lit(0))),
                       lambda x, i: of(x, *[F.get(values, i + j) for j in range(1, width)]))


def runs(found: Column, span: int) -> Column:
    """[fp, span, first, last]: the fingerprint of every start of a span, equal neighbours in one run."""
    k = (span + 1) // 2

    def made(minima: Column) -> Column:
        places = F.transform(minima, lambda x, i: F.struct(x.alias("fp"), i.alias("at")))
        heads = F.filter(places, lambda p: (p["at"] == 0) | (p["fp"] != F.get(minima, p["at"] - 1)))
        return let(heads, lambda h: F.transform(h, lambda p, j: F.struct(
            p["fp"].alias("fp"), F.lit(span).alias("span"), p["at"].alias("first"),
            (F.coalesce(F.get(h, j + 1)["at"], F.size(minima)) - 1).alias("last"))))

    hashes = F.transform(found, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(_sliding(h, k, F.xxhash64), lambda g: let(_sliding(g, span - k + 1, F.least), made)))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(window, span, item_set, items): every distinct span of the items and the ids of the items that hold it."""
    each = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = each.withColumn("span", F.least(F.size("w"), F.lit(span)))
    spans = F.transform(F.slice("w", F.lit(1), F.size("w") - F.col("span") + 1), lambda x, i: F.array_join(F.slice(F.col("w"), i + 1, F.col("span")), " "))
    held = each.select("item", "span", F.explode(spans).alias("window")).distinct()
    return (held.groupBy("window", "span").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select("window", "span", F.md5(F.array_join("items", ",")).alias("item_set"), "items"))


def _joined(rows: DataFrame, side: DataFrame, side_rows: int, on: list[str], salt: Column, how: str) -> DataFrame:
    """Join by key: with a small side broadcast, else in parts, so that a frequent key is spread over ``SALTS`` tasks."""
    if side_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), on, how)
    many = side.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(many, [*on, "salt"], how).drop("salt")


def shared_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Documents with what they share with the items, and the sets of items that they refer to.

    First: one row per document row, (doc_id, n_words, n_hit, spans, item_set); ``spans`` are the shared
    stretches as [start, end) word numbers, ascending and apart, null without a hit, as is ``item_set``.
    Second: (item_set, items), the sorted ids of every set.
    """
    windows = stored(item_windows(items, item_id, item_text, span), "windows")
    n_windows = windows.count()
    lengths = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most ``span`` numbers
    given = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"),
                        F.xxhash64(doc_id, text).alias("ka"), F.xxhash64(F.lit(13), text, doc_id).alias("kb"))

    def all_runs(of: Column) -> Column:
        return F.concat(*[runs(of, n) for n in lengths or [span]])

    prints = stored(windows.select("span", F.explode(all_runs(F.split("window", " "))).alias("r"))
                    .where("span = r.span").select("r.fp", "r.span").distinct(), "prints")
    # One pass over the texts: the runs that meet a fingerprint, and a mark of span 0 per document that carries its words.
    mark = lambda w: F.struct(F.col("ka").alias("fp"), F.lit(0).alias("span"), F.lit(0).alias("first"), F.size(w).alias("last"))
    marked = given.select("doc", "ka", "kb", F.explode(let(words(F.col("body")), lambda w: F.concat(F.array(mark(w)), all_runs(w)))).alias("r"))
    met = _joined(marked.select("doc", "ka", "kb", "r.*"), prints.withColumn("met", F.lit(True)), prints.count(), ["fp", "span"], F.col("kb"), "left")
    seen = stored(met.where("met OR span = 0").select("doc", "ka", "kb", "span", "first", "last"), "seen")
    counted = seen.where("span = 0").select("doc", "ka", "kb", F.col("last").cast("long").alias("n_words"))
    near = stored(seen.where("span > 0").groupBy("ka", "kb").agg(F.collect_set(F.struct("span", "first", "last")).alias("near")), "near")
    n_near = near.count()
    texts = given.join(F.broadcast(near.select("ka", "kb")), ["ka", "kb"], "left_semi") if n_near <= BROADCAST_ROWS else given
    starts = F.flatten(F.transform("near", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda s: F.struct(r["span"].alias("span"), s.alias("start")))))
    tried = texts.join(near, ["ka", "kb"]).select("ka", "kb", F.explode(let(words(F.col("body")), lambda w: F.transform(starts, lambda s: F.struct(
        s["span"].alias("span"), s["start"].alias("start"), F.array_join(F.slice(w, s["start"] + 1, s["span"]), " ").alias("window"))))).alias("s"))
    hits = _joined(tried.select("ka", "kb", "s.*"), windows.select("window", "span", "item_set"), n_windows, ["window", "span"], F.col("ka"), "inner")

    stretch = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("span")).alias("end"))))
    per_doc = hits.groupBy("ka", "kb").agg(stretch.alias("raw"), F.sort_array(F.collect_set("item_set")).alias("sets"))
    last = lambda acc: F.element_at(acc, -1)
    merged = F.aggregate("raw", F.slice("raw", 1, 1), lambda acc, x: F.when(
        x["start"] <= last(acc)["end"],
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    per_doc = stored(per_doc.select("ka", "kb", merged.alias("spans"), "sets", F.md5(F.array_join("sets", ",")).alias("item_set")), "hits")
    unions = (per_doc.groupBy("item_set").agg(F.first("sets").alias("sets")).select(F.col("item_set"), F.explode("sets").alias("s"))
              .join(windows.groupBy(F.col("item_set").alias("s")).agg(F.first("items").alias("items")), "s")
              .groupBy("item_set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    out = counted.join(per_doc.select("ka", "kb", "spans", "item_set"), ["ka", "kb"], "left")
    return out.select(F.col("doc").alias(doc_id), "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), "spans", "item_set"), unions


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``: hit words and a digest of the items found."""
    found, sets = shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = stored(sets.select("item_set", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "listed")
    # Documents without a set are spread by a key of their own.
    spread = found.withColumn("item_set", F.coalesce("item_set", F.concat(F.lit("-"), F.col("doc_id").cast("string")), F.lit("-")))
    return _joined(spread, listed, listed.count(), ["item_set"], F.xxhash64("doc_id"), "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
QUERIES = {"op13_decontaminate": op13_decontaminate}
ORACLE: dict[str, str] = {"op13_decontaminate": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT id, least(len(w), {SPAN}) AS n, array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' ') AS win
       FROM item, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM iw) AS lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, n, id FROM dw JOIN iw USING (win, n)),
covered AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM hit, unnest(range(0, n)) AS t(o) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM hit WHERE id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)"""}
