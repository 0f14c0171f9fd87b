"""Data-quality report (Q1-Q5): checks for traps the reference leaves silent.

One row per check: ``check`` (name), ``n_items`` (offending items). All checks
are aggregates over the tables; none collects rows to the driver.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import checkpoint_root
from . import coverage as CV

# ---- fixed values: check names ------------------------------------------------------
Q1_DUPLICATE_VIDEO_ID = "duplicate_video_id"
Q2_DUPLICATE_PATH_FRAME = "duplicate_path_frame"
Q3_NULL_MEDIA_TIME = "null_media_time"
Q4_VIDEO_WITHOUT_FRAMES = "video_without_frames"
Q5_FRAME_COUNT_MISMATCH = "frame_count_mismatch"
Q6_UNPARSEABLE_PATH = "unparseable_path"
# ---------------------------------------------------------------------------------------


def _one(name: str, n) -> DataFrame:
    return n.select(F.lit(name).alias("check"), F.col("n").cast("bigint").alias("n_items"))


def duplicate_video_ids(videos: DataFrame) -> DataFrame:
    """Q1: ids that name more than one video (the dict keeps one silently)."""
    return videos.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def frame_count_mismatch(coverage: DataFrame) -> DataFrame:
    """Q5: videos whose rows or distinct frames are not exactly 0 .. max(frame): a valid-looking index may then
    not decode. A gap stays visible where a duplicate row makes up for it in the row count."""
    expected = F.col("last_frame") + 1
    return coverage.filter((F.col("n_rows") != expected) | (F.col("n_distinct") != expected))


def videos_without_frames(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Q4: videos with no row in ``frames`` (e.g. a crash between the two writes).
    Frame ids are made distinct first: partial aggregation shrinks that side to
    video volume before its shuffle."""
    return videos.select("video_id").join(frames.select("video_id").distinct(), "video_id", "left_anti")


def per_video_checks(profile: DataFrame) -> DataFrame:
    """Q3 and unparseable paths in one pass over the (video-volume) profile."""
    vids = C.with_cruise_camera(profile.filter((F.col("n_frames") > 0) & ~C.is_skipped()))
    counts = vids.agg(
        F.count_if(C.parse_utc("media_time").isNull()).alias(Q3_NULL_MEDIA_TIME),
        F.count_if(F.col("cruise").isNull()).alias(Q6_UNPARSEABLE_PATH),
    )
    names = [Q3_NULL_MEDIA_TIME, Q6_UNPARSEABLE_PATH]
    return counts.unpivot([], names, "check", "n_items").select(
        "check", F.col("n_items").cast("bigint").alias("n_items"))


def quality_report(raw: DataFrame, profile: DataFrame, videos: DataFrame,
                   frames: DataFrame | None = None) -> DataFrame:
    checkpoint_root(raw.sparkSession)
    words = CV.frame_words(raw).checkpoint(eager=True)
    parts = [
        _one(Q1_DUPLICATE_VIDEO_ID, duplicate_video_ids(videos).agg(F.count(F.lit(1)).alias("n"))),
        # Q2: (media_path, frame) rows listed more than once (overlapping exports inflate frame_count).
        _one(Q2_DUPLICATE_PATH_FRAME, CV.frames_listed_again(words, raw)),
        _one(Q5_FRAME_COUNT_MISMATCH, frame_count_mismatch(CV.frame_coverage(words)).agg(F.count(F.lit(1)).alias("n"))),
        per_video_checks(profile),
    ]
    if frames is not None:
        parts.append(_one(Q4_VIDEO_WITHOUT_FRAMES,
                          videos_without_frames(videos, frames).agg(F.count(F.lit(1)).alias("n"))))
    return reduce(DataFrame.unionByName, parts)
