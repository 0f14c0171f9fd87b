"""The per-frame table: projection (P2), global order (O1), write layout (O2)
and one-cruise reads (F5)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import FRAME_COLUMNS


def frames_with_keys(raw: DataFrame) -> DataFrame:
    """F3 rows projected to the frame columns, keeping ``media_path`` and
    ``camera`` so restrictions to a write set can be applied before the
    projection drops them."""
    ok = raw.filter(C.is_ok_frame())
    return C.with_cruise_camera(ok).select(
        F.col("media").alias("video_id"),
        F.col("frame").alias("frame_index"),
        C.parse_utc("times").alias("frame_time"),
        "status",
        "cruise",
        "camera",
        "media_path",
    )


def frames_table(raw: DataFrame) -> DataFrame:
    """Frame rows in the ``frames`` column order (not sorted)."""
    return frames_with_keys(raw).select(*FRAME_COLUMNS)


def frames_sorted(raw: DataFrame) -> DataFrame:
    """O1: globally sorted by (cruise, video_id, frame_index); the index sorts as a LONG."""
    return frames_table(raw).orderBy("cruise", "video_id", "frame_index")


def write_layout(frames: DataFrame) -> DataFrame:
    """O2 / S7 layout for one append of the whole table, all cruises in one job.

    ``rebalance(cruise)`` keeps a cruise's rows together when it is small and,
    under AQE, splits a hot cruise into several right-sized tasks instead of one
    straggler; each task then sorts its rows by (cruise, video_id, frame_index)
    so every Parquet file has tight min/max ranges for row-group pruning.
    """
    return (frames.hint("rebalance", "cruise")
            .sortWithinPartitions("cruise", "video_id", "frame_index"))


def one_cruise(frames: DataFrame, cruise: str) -> DataFrame:
    """one cruise's frames; against the store this is a partition filter."""
    return frames.filter(F.col("cruise") == F.lit(cruise))
