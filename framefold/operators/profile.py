"""Media profile (A7) and everything that rolls up from it: videos (A1, P1),
exclusion counts (A2), id/link count (A3) and partitions (A4).

One scan, two exchanges. The frame-volume step is a hash aggregate on
``(media_path, media, media_time)`` with map-side partial aggregation, so a hot
video collapses to one row per mapper before anything is shuffled. The
value-picking step (``min_by`` on strings, a sort aggregate) only ever sees the
reduced rows, one per (path, media, media_time), i.e. video volume.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import VIDEO_COLUMNS


def media_profile(raw: DataFrame) -> DataFrame:
    """One row per ``media_path`` (null path included) with every count the ingest needs.

    Columns: media_path, media, media_time (text, taken at the lowest frame),
    n_rows, n_frames (rows with a frame), n_sentinel (rows without), min_frame,
    max_frame, n_id_link (rows with non-empty id/link).
    """
    return merge_parts(profile_parts(raw))


def profile_parts(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mergeable state of the profile: a row per (media_path, media, media_time), and per ``by`` if given."""
    return raw.groupBy(*by, "media_path", "media", "media_time").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("frame").alias("n_frames"),
        F.count_if(C.is_sentinel()).alias("n_sentinel"),
        F.min("frame").alias("min_frame"),
        F.max("frame").alias("max_frame"),
        F.count_if(C.id_link_nonempty(raw.columns)).alias("n_id_link"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """The profile from parts of any number of scans; only the reduced rows are shuffled by path."""
    # Value at the lowest frame; deterministic tie-break on the values themselves.
    # Groups without any frame have a null ordering and are ignored by min_by.
    pick_order = F.when(F.col("min_frame").isNotNull(),
                        F.struct("min_frame", "media", "media_time"))
    # The rows are shuffled as they are: there is hardly one to merge before, and min_by would sort them all for it.
    # After the shuffle the hash leads the sort: paths share long beginnings, which are slow to compare.
    dealt = parts.repartition("media_path").withColumn("_hash", F.xxhash64("media_path"))
    step2 = dealt.groupBy("_hash", "media_path").agg(
        F.min_by(F.struct("media", "media_time"), pick_order).alias("first"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_frames").alias("n_frames"),
        F.sum("n_sentinel").alias("n_sentinel"),
        F.min("min_frame").alias("min_frame"),
        F.max("max_frame").alias("max_frame"),
        F.sum("n_id_link").alias("n_id_link"),
    )
    return step2.select(
        "media_path",
        F.col("first.media").alias("media"),
        F.col("first.media_time").alias("media_time"),
        "n_rows", "n_frames", "n_sentinel", "min_frame", "max_frame", "n_id_link",
    )


def videos_from_profile(profile: DataFrame, strict_paths: bool = False) -> DataFrame:
    """A1 + P1: one row per video in the ``videos`` column order.

    A video is a media path with at least one frame row that is not parked
    under ``/skip/``. ``strict_paths`` fails the job on a path too short to
    parse (the reference's behaviour); otherwise cruise/camera come back null.
    """
    kept = profile.filter((F.col("n_frames") > 0) & ~C.is_skipped())
    return C.with_cruise_camera(kept, strict=strict_paths).select(
        F.col("media").alias("video_id"),
        "media_path",
        F.col("n_frames").alias("frame_count"),
        C.parse_utc("media_time").alias("media_time"),
        "cruise",
        "camera",
    ).select(*VIDEO_COLUMNS)


def videos(raw: DataFrame, strict_paths: bool = False) -> DataFrame:
    return videos_from_profile(media_profile(raw), strict_paths)


def exclusion_counts(profile: DataFrame) -> DataFrame:
    """A2: distinct media paths per exclusion reason; skip wins over bad-file."""
    skipped = C.is_skipped()
    return profile.agg(
        F.count_if((F.col("n_sentinel") > 0) & ~skipped).alias("bad_file"),
        F.count_if(skipped).alias("skipped"),
    )


def id_link_count(profile: DataFrame) -> DataFrame:
    """A3: rows with non-empty id or link over the whole scan (before F3)."""
    return profile.agg(F.coalesce(F.sum("n_id_link"), F.lit(0)).cast("bigint").alias("id_link_nonempty"))


def scan_summary(profile: DataFrame) -> DataFrame:
    """A2 + A3 and the row totals in one pass over the (small) profile."""
    skipped = C.is_skipped()
    kept = (F.col("n_frames") > 0) & ~skipped
    return profile.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("raw_rows"),
        F.count_if((F.col("n_sentinel") > 0) & ~skipped).alias("bad_file"),
        F.count_if(skipped).alias("skipped"),
        F.coalesce(F.sum("n_id_link"), F.lit(0)).cast("bigint").alias("id_link_nonempty"),
        F.count_if(kept).alias("videos"),
        F.coalesce(F.sum(F.when(kept, F.col("n_frames"))), F.lit(0)).cast("bigint").alias("frames"),
    )


def partitions(videos_df: DataFrame) -> DataFrame:
    """A4 / U4 / O3: distinct (cruise, camera), sorted."""
    return videos_df.select("cruise", "camera").distinct().orderBy("cruise", "camera")


def ok_frames(raw: DataFrame) -> DataFrame:
    """rows that belong in the manifest."""
    return raw.filter(C.is_ok_frame())
