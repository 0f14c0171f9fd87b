"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one text. Every word goes that lies in
a window whose word sequence also starts in a document with a smaller id; windows
are judged on the input.

1. *Sketch.* Each window has an anchor, the smallest hash among its ``ANCHOR``-word
   phrases. Equal windows have equal anchors, so an anchor occurs at least as often
   as each window it stands for. Every partition counts its anchors in a count-min
   sketch (``ROWS`` rows, counters saturating at 2, sent as slices of cell numbers);
   merging the slices leaves one bit a cell: "reached 2 over the whole corpus". The
   plane of bits is at most ``ROWS * MAX_WIDTH`` bits (96 MB) and is broadcast; beyond
   that width it lets more windows through, and the result is the same.
2. *Exact grouping of the windows estimated repeated.* Documents are dealt into chunks
   of about 2 MB. A chunk sends each of its distinct surviving windows (96-bit name,
   smallest id in the chunk) to the shard of that name; the shard finds the smallest id
   of all and answers the chunk only where another chunk has a smaller one. A window
   costs one request a chunk however many documents hold it, so no key is hot.
3. The chunk, cogrouped with its answers, marks and drops the covered words.

Defined results: null text counts as empty; fewer words than a window: nothing removed;
a row without id neither loses words nor takes any from others; rows with equal ids do
not take words from each other; repeated rows give repeated results; an empty table gives
an empty one; other columns pass through, and input columns named like the results
(``n_words``, ``n_removed``, ``removed``, ``kept_text``) are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framefold.llm.scratch import chunk_of, power_of_two, table, text_bytes
from framefold.llm.words import Words, join_kept, mix, slices, windows

WINDOW = 50
ANCHOR = 25
ROWS = 3
MAX_WIDTH = 1 << 28
SLICE_BITS = 18
CHUNK_BYTES = 2 << 20
KEY = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8")])
ANSWER = np.dtype([("at", "<u4"), ("id", "<i8")])
ADDED = ("n_words", "n_removed", "removed", "kept_text")


def anchors(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each whole window, position of its anchor)."""
    starts = np.flatnonzero(w.room() >= window)
    k = min(ANCHOR, window)
    g = windows(h, k, salt=11)
    if not len(starts):
        return starts, starts
    span = window - k + 1
    # Sliding minimum by doubling: at[i] is the leftmost smallest of g[i:i+width].
    at, width = np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        width += step
    return starts, at[starts]


def cells(g: np.ndarray, width: int) -> np.ndarray:
    """The sketch cell of each hash in each row: shape (ROWS, len(g))."""
    return np.stack([(mix(g + np.uint64(r + 1)) & np.uint64(width - 1)) + np.uint64(r * width) for r in range(ROWS)])


def sketch(docs: DataFrame, window: int, width: int) -> np.ndarray:
    """Packed bits over the cells: set where the merged count is at least 2."""
    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            c = np.sort(np.concatenate(held))
            same = c[1:] == c[:-1]
            c = c[~np.concatenate([[False, False], same[1:] & same[:-1]])]  # a third copy says no more than two
            edge = np.flatnonzero(np.diff(c >> np.uint64(SLICE_BITS), prepend=np.uint64(1 << 60)))
            parts = np.split((c & np.uint64((1 << SLICE_BITS) - 1)).astype("<u4"), edge[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array((c[edge] >> np.uint64(SLICE_BITS)).astype(np.int32)),
                 pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "cells"])

        for batch in batches:
            for _, _, w in slices(batch.column(0)):
                h = w.hashes()
                _, at = anchors(w, h, window)
                if len(at):
                    g = windows(h, min(ANCHOR, window), salt=11)[np.unique(at)]
                    held.append(cells(g, width).ravel())
                    size += held[-1].size
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(part: pa.Table) -> pa.Table:
        count = np.zeros(1 << SLICE_BITS, np.uint32)
        for b in part.column("cells"):
            np.add.at(count, np.frombuffer(b.as_buffer(), "<u4"), 1)
        return pa.table({"slice": part.column("slice")[:1].cast(pa.int32()),
                         "bits": pa.array([np.packbits(count >= 2, bitorder="little").tobytes()], pa.binary())})

    rows = (docs.mapInArrow(partials, "slice int, cells binary")
            .groupBy("slice").applyInArrow(merge, "slice int, bits binary").toLocalIterator())
    plane = np.zeros(-(-ROWS * width // 8), np.uint8)
    for s, bits in rows:
        part = np.frombuffer(bits, np.uint8)
        lo = s << (SLICE_BITS - 3)
        plane[lo:lo + len(part)] = part[:len(plane) - lo]
    return plane


def estimated_repeated(w: Words, window: int, width: int, plane: np.ndarray) -> np.ndarray:
    """Starts of the windows whose anchor may occur twice in the corpus."""
    h = w.hashes()
    starts, at = anchors(w, h, window)
    if not len(at):
        return starts
    used, back = np.unique(at, return_inverse=True)
    c = cells(windows(h, min(ANCHOR, window), salt=11)[used], width)
    hit = ((plane[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
    return starts[hit[back]]


def chunk_windows(part: pa.Table, window: int, width: int, plane: np.ndarray):
    """The chunk's slices with their surviving windows, and its distinct keys in order.

    Returns ([(lo, hi, words, starts, key number of each start)], keys).
    """
    ids = part.column("__id").combine_chunks()
    known = np.asarray(ids.is_valid())
    number = np.asarray(ids.fill_null(0)).astype(np.int64)
    found, keys = [], []
    for lo, hi, w in slices(part.column("__text")):
        starts = estimated_repeated(w, window, width, plane)
        starts = starts[known[lo:hi][w.doc[starts]]]
        k = np.zeros(len(starts), KEY)
        if len(starts):
            k["a"] = windows(w.hashes(), window)[starts]
            k["b"] = windows(w.hashes(salt=2), window, salt=8)[starts] >> np.uint64(32)
            k["id"] = number[lo:hi][w.doc[starts]]
        found.append((lo, hi, w, starts))
        keys.append(k)
    every = np.concatenate(keys) if keys else np.zeros(0, KEY)
    distinct, back = first_of_key(every)
    cut = np.cumsum([len(k) for k in keys])[:-1] if keys else []
    return [(*f, b) for f, b in zip(found, np.split(back, cut), strict=True)], distinct


def first_of_key(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, b) in order with their smallest id, and the number of each row's key."""
    order = np.lexsort((every["id"], every["b"], every["a"]))
    s = every[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], back


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, removed (word spans) and kept_text (see the module)."""
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    width = power_of_two(size / 32, 1 << SLICE_BITS, MAX_WIDTH)
    shard_bits = power_of_two(size / (1 << 20), 8, 1 << 24).bit_length() - 1
    plane = spark.sparkContext.broadcast(sketch(docs.select(text), window, width))
    passing = [c for c in docs.columns if c not in (doc_id, text, *ADDED)]
    chunks = docs.select(
        chunk_of(size // CHUNK_BYTES + 1, F.col(doc_id), F.col(text)).alias("__chunk"),
        F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"),
        F.struct(F.lit(True).alias("__row"), *[F.col(c) for c in passing]).alias("__rest"))

    def ask(part: pa.Table) -> pa.Table:
        _, keys = chunk_windows(part, window, width, plane.value)
        shard = (keys["a"] >> np.uint64(64 - shard_bits)).astype(np.int32)
        edge = np.flatnonzero(np.diff(shard, prepend=-1))
        n = len(edge)
        return pa.table({"shard": pa.array(shard[edge]), "chunk": pa.array([part.column("__chunk")[0].as_py()] * n, pa.int32()),
                         "base": pa.array(edge.astype(np.int32)),
                         "keys": pa.array([k.tobytes() for k in np.split(keys, edge[1:])] if n else [], pa.binary())})

    def answer(part: pa.Table) -> pa.Table:
        sent = [np.frombuffer(b.as_buffer(), KEY) for b in part.column("keys")]
        least, back = first_of_key(np.concatenate(sent))
        chunk, replies, lo = [], [], 0
        for c, base, k in zip(part.column("chunk").to_pylist(), part.column("base").to_pylist(), sent, strict=True):
            least_id = least["id"][back[lo:lo + len(k)]]
            lo += len(k)
            at = np.flatnonzero(least_id < k["id"])
            if len(at):
                r = np.zeros(len(at), ANSWER)
                r["at"], r["id"] = at + base, least_id[at]
                chunk.append(c)
                replies.append(r.tobytes())
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "replies": pa.array(replies, pa.binary())})

    def finish(part: pa.Table, told: pa.Table) -> pa.Table:
        found, keys = chunk_windows(part, window, width, plane.value)
        least = keys["id"].copy()
        for b in told.column("replies"):
            r = np.frombuffer(b.as_buffer(), ANSWER)
            least[r["at"]] = r["id"]
        ids = np.asarray(part.column("__id").combine_chunks().fill_null(0)).astype(np.int64)
        n_words, n_removed, spans, kept = [], [], [], []
        for lo, hi, w, starts, back in found:
            gone = starts[ids[lo:hi][w.doc[starts]] > least[back]]
            depth = np.zeros(len(w) + 1, np.int32)
            np.add.at(depth, gone, 1)
            np.add.at(depth, gone + window, -1)
            drop = np.cumsum(depth[:-1]) > 0
            n_words.append(w.counts)
            n_removed.append(np.bincount(w.doc[drop], minlength=hi - lo))
            spans.append(word_spans(w, drop))
            kept.append(join_kept(w, ~drop))
        none = pa.chunked_array([pa.array([], SPANS)])
        return pa.table({"__id": part.column("__id"), "__text": part.column("__text"), "__rest": part.column("__rest"),
                         "n_words": pa.array(np.concatenate(n_words or [[]]).astype(np.int64)),
                         "n_removed": pa.array(np.concatenate(n_removed or [[]]).astype(np.int64)),
                         "removed": pa.chunked_array(spans) if spans else none,
                         "kept_text": pa.chunked_array(kept) if kept else pa.array([], pa.string())})

    asked = chunks.groupBy("__chunk").applyInArrow(ask, "shard int, chunk int, base int, keys binary")
    told = asked.groupBy("shard").applyInArrow(answer, "chunk int, replies binary")
    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("__text", T.StringType()),
                           T.StructField("__rest", chunks.schema["__rest"].dataType),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
                           T.StructField("kept_text", T.StringType())])
    # Empty chunks do not exist, so every cogroup has documents on its left.
    done = chunks.groupBy("__chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema)
    return done.select(F.col("__id").alias(doc_id), F.col("__text").alias(text),
                       *[F.col("__rest")[c].alias(c) for c in passing], *ADDED)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def word_spans(w: Words, drop: np.ndarray) -> pa.Array:
    """Per text, the runs of dropped words as [start, end) word numbers of the text."""
    n = len(drop)
    first = drop.copy()
    first[1:] &= ~drop[:-1] | (w.doc[1:] != w.doc[:-1])
    last = drop.copy()
    last[:-1] &= ~drop[1:] | (w.doc[1:] != w.doc[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = w.doc[lo] if n else lo
    begin = w.bounds[:-1][doc]
    values = pa.StructArray.from_arrays([pa.array((lo - begin).astype(np.int32)), pa.array((hi - begin).astype(np.int32))], ["start", "end"])
    offsets = np.searchsorted(doc, np.arange(len(w.counts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values).cast(SPANS)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, n_words, n_removed, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE = {
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM g),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE least < doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT r.doc_id, string_agg(word, ' ' ORDER BY r.j) AS kept FROM r
      LEFT JOIN (SELECT doc_id, unnest(gone) AS j FROM c) x ON r.doc_id = x.doc_id AND r.j = x.j
      WHERE x.j IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(c.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
""",
}
