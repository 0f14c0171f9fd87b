"""Embedding near-dedup by an epsilon grid order join.

Unit vectors have cosine >= t exactly when their distance is at most ``eps = sqrt(2 - 2t)``.
The vectors are rotated onto their principal axes (a rotation keeps distances), and the
leading ``AXES`` coordinates are cut into cells of width eps. Sorting by cell gives the
epsilon grid order; its sequence is cut into blocks by range partitioning. Two
blocks are joined only if their boxes on the leading axes, and their ranges of the length left
in the other axes, lie within eps. A pair of blocks is one group: it halves the
longer interval again and again, skips pairs of intervals whose boxes are too far, and compares
small intervals with one matrix product in double precision.

Equal vectors form a class with one representative, so copies are never compared. A pair
of blocks returns, per vector, its number of links and the smallest id of its connected group
inside the pair: at most one row a vector, however many pairs link.

Defined results: a vector that is null, zero, or has null or non-finite components links with nothing, and
vectors link only with vectors of their length (the join runs once for each length that occurs: one
per embedding model); a null id gets no component; repeated rows with one id count once as partner; an empty
table gives an empty one; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.components import components
from framefold.llm.scratch import stored, table

COSINE = 0.9
AXES = 8
BLOCK_ROWS = 4096
LEAF_ROWS = 512
SLACK = 1e-6


def matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # first by the largest component: squares of huge values overflow
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all vectors, the most important first, one per column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        n = 0
        for batch in batches:
            u = unit(matrix(batch.column(0), width))
            total[:width] += u.T @ u
            total[width] += u.sum(axis=0)
            n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), n)])], ["v"])

    sums = (vectors.select("v").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x"))
            .groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect())  # (width + 1) * width + 1 rows
    s = np.array([r["x"] for r in sums])
    n, second, mean = max(s[-1], 1), s[:width * width].reshape(width, width), s[width * width:-1]
    return np.linalg.eigh(second / n - np.outer(mean / n, mean / n))[1][:, ::-1]


def box_gap(lo1, hi1, lo2, hi2) -> np.ndarray:
    return np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))


def interval_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, cosine: float, found: np.ndarray, i: int, j: int) -> None:
    """Mark in ``found`` the links between interval a (from row i) and b (from column j)."""
    gap = box_gap(pa_.min(0), pa_.max(0), pb.min(0), pb.max(0))
    if (gap * gap).sum() > eps * eps + SLACK:
        return
    if max(len(a), len(b)) <= LEAF_ROWS:
        found[i:i + len(a), j:j + len(b)] = a @ b.T >= cosine
        return
    if len(a) >= len(b):
        h = len(a) // 2
        interval_join(a[:h], b, pa_[:h], pb, eps, cosine, found, i, j)
        interval_join(a[h:], b, pa_[h:], pb, eps, cosine, found, i + h, j)
    else:
        h = len(b) // 2
        interval_join(a, b[:h], pa_, pb[:h], eps, cosine, found, i, j)
        interval_join(a, b[h:], pa_, pb[h:], eps, cosine, found, i, j + h)


def groups(found: np.ndarray, ida: np.ndarray, idb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of the connected group of each row and column of the link matrix."""
    la, lb = ida.copy(), idb.copy()
    open_a = found.any(axis=1)
    while open_a.any():
        rows = np.zeros(len(ida), bool)
        cols = np.zeros(len(idb), bool)
        edge = np.flatnonzero(open_a)[:1]
        while len(edge):
            rows[edge] = True
            new = found[edge].any(axis=0) & ~cols
            cols |= new
            edge = np.flatnonzero(found[:, new].any(axis=1) & ~rows)
        least = min(ida[rows].min(), idb[cols].min())
        la[rows], lb[cols] = least, least
        open_a &= ~rows
    return la, lb


def links(vectors: DataFrame, width: int, cosine: float) -> DataFrame:
    """(id, n, peer) from (id, size, v): links found in a pair of blocks, weighed by class size."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    turn = axes(vectors, width)
    lead = min(AXES, width)

    def coordinates(u: np.ndarray) -> np.ndarray:
        p = u @ turn
        rest = np.sqrt(np.maximum(0, 1 - (p[:, :lead] ** 2).sum(axis=1)))
        return np.column_stack([p[:, :lead], rest])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.floor(coordinates(unit(matrix(batch.column("v"), width)))[:, :lead] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cell))], [*batch.schema.names, "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                v = matrix(part.column("v"), width)
                p = coordinates(unit(v))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.min(0)]), pa.array([p.max(0)]), pa.array([np.asarray(part.column("id")).astype("<i8").tobytes()], pa.binary()),
                     pa.array([np.asarray(part.column("size")).astype("<i8").tobytes()], pa.binary()), pa.array([v.astype("<f8").tobytes()], pa.binary())],
                    ["lo", "hi", "ids", "sizes", "rows"])

    n = vectors.count()
    ordered = (vectors.mapInArrow(place, "id long, size long, v array<double>, cell array<int>")
               .repartitionByRange(max(1, -(-n // BLOCK_ROWS)), "cell", "id").sortWithinPartitions("cell", "id").select("id", "size", "v"))
    blocks = stored(ordered.mapInArrow(pack, "lo array<double>, hi array<double>, ids binary, sizes binary, rows binary")
                    .withColumn("block", F.monotonically_increasing_id()), "blocks")
    cells = F.sequence(F.floor(F.col("lo")[0] / eps).cast("int"), F.floor(F.col("hi")[0] / eps).cast("int") + 1)
    boxes = blocks.select("block", "lo", "hi", F.explode(cells).alias("cell"))
    left = boxes.select(F.col("block").alias("a"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), "cell")
    right = boxes.select(F.col("block").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "cell")
    gaps = F.transform(F.arrays_zip("lo1", "hi1", "lo2", "hi2"), lambda x: F.pow(F.greatest(F.lit(0.0), x["lo1"] - x["hi2"], x["lo2"] - x["hi1"]), F.lit(2)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) <= eps * eps + SLACK
    pairs = left.join(right, "cell").where("a <= b").where(near).select("a", "b").distinct()
    load = lambda side: blocks.select(F.col("block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("ids", "sizes", "rows")])
    loaded = pairs.join(load("a"), "a").join(load("b"), "b")

    def compare(part: pa.Table) -> pa.Table:
        get = lambda c, kind: np.frombuffer(part.column(c)[0].as_buffer(), kind)
        ida, idb, na, nb = get("ids_a", "<i8"), get("ids_b", "<i8"), get("sizes_a", "<i8"), get("sizes_b", "<i8")
        a, b = unit(get("rows_a", "<f8").reshape(-1, width)), unit(get("rows_b", "<f8").reshape(-1, width))
        same = part.column("a")[0].as_py() == part.column("b")[0].as_py()
        found = np.zeros((len(a), len(b)), bool)
        interval_join(a, b, coordinates(a), coordinates(b), eps, cosine, found, 0, 0)
        if same:
            np.fill_diagonal(found, False)
        la, lb = groups(found, ida, idb)
        ids, n, peer = [ida], [found.astype(np.float64) @ nb], [la]
        if not same:
            ids, n, peer = [ida, idb], [n[0], na @ found.astype(np.float64)], [la, lb]
        ids, n, peer = np.concatenate(ids), np.concatenate(n).astype(np.int64), np.concatenate(peer)
        return pa.table({"id": ids[n > 0], "n": n[n > 0], "peer": peer[n > 0]})

    return stored(loaded.groupBy("a", "b").applyInArrow(compare, "id long, n long, peer long"), "links")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept."""
    given = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    widths = sorted(r["w"] for r in given.where(usable).select(F.size("v").alias("w")).distinct().collect())
    named = F.when(usable, F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))
    marked = stored(given.withColumn("name", named), "vectors")
    classes = (marked.where("name is not null").groupBy("name")
               .agg(F.min("id").alias("rep"), F.count_distinct("id").alias("size"), F.min("v").alias("v")))
    alone = marked.where("name is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if widths:
        reps = stored(classes.select(F.col("rep").alias("id"), "size", "v", "name"), "classes")
        found = reduce(DataFrame.union, [links(reps.where(F.size("v") == w).select("id", "size", "v"), w, cosine) for w in widths])
        counted = found.groupBy("id").agg(F.sum("n").alias("n"))
        linked = components(found, "id", "peer")
        known = (reps.join(counted, "id", "left").join(linked, "id", "left")
                 .select("name", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
        alone = alone.union(marked.where("name is not null").join(known, "name").select("id", "n_links", "component"))
    return alone.select(F.col("id").alias(vec_id), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op9_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``: vec_id, n_links, component_id, kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_ego_join": op9_ego_join}
ORACLE: dict[str, str] = {}
