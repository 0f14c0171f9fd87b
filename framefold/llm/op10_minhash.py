"""MinHash near-dedup: one-permutation hashing, optimal densification, star candidates.

1. Each text's word shingles are hashed once; the hash range is cut into
   ``BANDS * ROWS`` bins and each bin keeps its least value. Empty bins borrow from the
   first filled bin of a fixed random probe sequence (optimal densification). Bands of
   ``ROWS`` bins make bucket keys: a pair at similarity 0.8 misses all buckets with
   probability 3e-6.
2. Documents with equal shingle sets (128-bit set name) form a class, represented by its
   smallest id; only representatives enter buckets.
3. ``STAR_ROUNDS`` rounds of stars: every bucket pairs its most connected member (the one
   whose buckets are fullest) with the members of other components, the pairs are confirmed
   on the full shingle sets, and components are merged. The centres then leave their buckets.
   A round costs at most one pair per bucket row and merges large groups at once.
4. Buckets that still hold several components are compared in full: a bucket is dealt into
   blocks of about ``BLOCK_ITEMS`` shingles, and each pair of blocks is one group that compares
   all members of different components by an inverted index of their sets. It returns only
   links that join components, so no pair of documents is ever a row.

So every pair that shares a bucket is confirmed or refuted, unless its documents are linked already.

Defined results: null, empty or wordless text has an empty set and links with nothing;
fewer words than a shingle make one shingle of all words; a row without id links with
nothing and gets no component; repeated rows give repeated results; an empty table gives
an empty one; other columns are ignored here and pass through ``near_duplicates``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.components import components
from framefold.llm.op3_fertility import ranges
from framefold.llm.scratch import drop_stored, stored, table
from framefold.llm.words import Words, mix, slices, spans

BANDS = 32
ROWS = 5
STAR_ROUNDS = 2
BLOCK_ITEMS = 1 << 17
MEMBER_ITEMS = 16  # what a member weighs besides its shingles
SIMILARITY_PERCENT = 80
EMPTY = np.uint32(0xFFFFFFFF)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle occurrence, in order of texts."""
    h = w.hashes(lower=True)
    room = w.room()
    position = np.arange(len(w))
    whole = (w.counts[w.doc] < k) & (position == w.bounds[:-1][w.doc])
    lo = np.flatnonzero((room >= k) | whole)
    hi = lo + np.minimum(room[lo], k)
    return mix(spans(h, lo, hi) + (hi - lo).astype(np.uint64)), w.doc[lo]


def distinct_shingles(w: Words, k: int) -> list[np.ndarray]:
    """Per text, its set of shingle hashes in order."""
    x, doc = shingles(w, k)
    cut = np.searchsorted(doc, np.arange(1, len(w.counts)))
    return [np.unique(s) for s in np.split(x, cut)]


def one_permutation(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Least value per bin, shape (texts, bins); rows of empty sets stay EMPTY."""
    size = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), size)
    at = doc * bins + ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * bins, EMPTY, np.uint32)
    np.minimum.at(least, at, (x & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    least = least.reshape(len(sets), bins)
    return densified(least)


def densified(least: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled bin on their own probe sequence."""
    n, bins = least.shape
    filled = least != EMPTY
    out = least.copy()
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        probe = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 24)) % np.uint64(bins)).astype(np.int64)
        to = probe[col]
        hit = filled[row, to]
        out[row[hit], col[hit]] = least[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band; the band number is part of the key."""
    n, bins = signature.shape
    parts = signature.reshape(n, bins // rows, rows).astype(np.uint64)
    key = np.arange(1, bins // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((n, 1), np.uint64)
    for r in range(rows):
        key = mix(key + parts[:, :, r] + np.uint64(r + 1))
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, s1, s2, keys): set size, 128-bit set name and bucket keys of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in slices(batch.column(1)):
                sets = distinct_shingles(w, k)
                keys = band_keys(one_permutation(sets, bands * rows), rows)
                offsets = np.arange(hi - lo + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([mix(s + np.uint64(99)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["id", "n", "s1", "s2", "keys"])
    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, items): the full shingle set of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in slices(batch.column(1)):
                sets = distinct_shingles(w, k)
                size = np.array([len(s) for s in sets])
                items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                 pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(size.astype(np.int64)), items], ["id", "n", "items"])
    return docs.mapInArrow(run, "id long, n long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are at least ``percent`` similar."""
    left = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("xb"))
    right = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("items").alias("xa"))
    both = F.size(F.array_intersect("xa", "xb"))
    return (pairs.join(left, "b").join(right, "a")
            .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent)
            .select("a", "b").distinct())


def block_links(x: int, y: int, block: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, items: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of blocks ``x`` and ``y`` that join components; ``items`` holds the ``n`` shingles of each member."""
    _, code, often = np.unique(items, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), n)
    shared = often[code] > 1  # a shingle of one member is in no intersection
    code, owner = code[shared], owner[shared]
    size = np.bincount(owner, minlength=len(ids))
    start = np.cumsum(size) - size
    right = block[owner] == y
    order = np.argsort(code[right], kind="stable")
    holder = owner[right][order]
    holders = np.bincount(code[right], minlength=len(often))
    place = np.cumsum(holders) - holders
    _, label = np.unique(component, return_inverse=True)
    links = []
    for i in np.flatnonzero(block == x):
        other = (label != label[i]) & (block == y) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
        if x == y:
            other[:i] = False
        if not other.any():
            continue
        c = code[start[i]:start[i] + size[i]]
        both = np.bincount(holder[ranges(place[c], holders[c])], minlength=len(ids))
        for j in np.flatnonzero(other & (both * 100 >= (n + n[i] - both) * percent)):
            if label[j] != label[i]:
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def bucket_links(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components left in each bucket of (key, id, n, component)."""
    load = open_rows.groupBy("key").agg(F.ceil(F.sum(F.col("n") + MEMBER_ITEMS) / BLOCK_ITEMS).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (open_rows.join(load, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .select("key", "id", "component", "block", other.alias("other"))
             .select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "component"))

    def compare(part: pa.Table) -> pa.Table:
        get = lambda c: np.asarray(part.column(c))
        found = block_links(int(get("x")[0]), int(get("y")[0]), get("block"), get("id"), get("component"), get("n"),
                            np.asarray(part.column("items").combine_chunks().flatten()), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.join(sets, "id").groupBy("key", "x", "y").applyInArrow(compare, "a long, b long")


def link_classes(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS,
                 percent: int = SIMILARITY_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(id, n, s1, s2) of every row with an id, and (id, component) of the linked representatives.

    ``docs`` has two columns: a long id and a text.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(docs.columns[0]).isNotNull())
    sig = stored(signatures(known, k, bands, rows), "signatures")
    full = sig.where("n > 0")
    reps = full.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"))
    buckets = (full.join(reps, ["s1", "s2", "n", "id"], "left_semi")
               .select("id", "n", F.explode("keys").alias("key")))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(buckets.join(shared, "key"), "buckets")
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    held = stored(members.join(degree, "id").select("key", "id", "n", "degree"), "buckets")
    drop_stored(spark, members)
    columns = docs.columns
    candidates = held.select(F.col("id").alias(columns[0])).distinct()
    sets = stored(shingle_sets(known.join(candidates, columns[0], "left_semi").select(*columns), k), "shingles")
    linked = spark.createDataFrame([], "id long, component long")
    tested = spark.createDataFrame([], "a long, b long")
    for step in range(STAR_ROUNDS + 1):
        marked = held.join(linked, "id", "left").select("key", "id", "n", "degree", F.coalesce("component", "id").alias("component"))
        centre = (marked.groupBy("key")
                  .agg(F.max(F.struct("degree", (-F.col("id")).alias("back"), F.col("component").alias("c"))).alias("m"),
                       F.min("component").alias("lo"), F.max("component").alias("hi"))
                  .where("lo < hi").select("key", (-F.col("m.back")).alias("centre"), F.col("m.c").alias("c")))
        open_rows = stored(marked.join(centre, "key"), "open")
        if open_rows.isEmpty():
            break
        if step < STAR_ROUNDS:
            pairs = open_rows.where("component <> c").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
            pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.union(pairs)
            links = stored(confirmed(pairs, sets, percent), "links")
            held = open_rows.where("id <> centre").select("key", "id", "n", "degree")
        else:
            links = stored(bucket_links(open_rows.select("key", "id", "n", "component"), sets.select("id", "n", "items"), percent), "links")
        if not links.isEmpty():
            linked = components(links.union(linked.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    return sig.select("id", "n", "s1", "s2"), linked


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = SIMILARITY_PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sig, linked = link_classes(keyed, k, percent=percent)
    full = sig.where("n > 0")
    reps = full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    grouped = reps.join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    found = full.join(grouped, ["s1", "s2", "n"]).select("id", "n", "component")
    alone = sig.where("n = 0").select("id", "n", F.col("id").alias("component"))
    nameless = signatures(keyed.where("id is null"), k, 1, 1).select("id", "n", F.lit(None).cast("long").alias("component"))
    return found.union(alone).union(nameless).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, 2-word shingles: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


QUERIES = {"op10_minhash": op10_minhash}
ORACLE: dict[str, str] = {}
