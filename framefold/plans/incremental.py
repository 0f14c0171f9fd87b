"""Incremental media profile (A1-A3, A7): every file is read once, ever.

The state is what each file holds of each video (``operators.profile.profile_parts``), keyed by path, size and
modification time. A scan lists the files, reads those whose version is not in the state, adds what they
hold, and merges the state of the listed files at video volume. A file listed twice counts twice,
as it does in a full scan; a changed file is a new version, and the old one is simply not listed any more.
"""
from __future__ import annotations

import logging
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile as PR
from ..schemas import FILE_KEYS
from ..sources.csv_scan import list_frames_csv, plain_path, read_frames_of_files
from ..sources.store import ManifestStore

log = logging.getLogger("framefold.incremental")

COUNTS = ["n_rows", "n_frames", "n_sentinel", "n_id_link"]


def current_parts(spark: SparkSession, store: ManifestStore, patterns: list[str], exclude: list[str] | tuple = ()) -> tuple[DataFrame, list[str]]:
    """The state of all listed files, brought up to date, and the files that had to be read for it."""
    listing = list_frames_csv(spark, patterns, exclude)
    times = Counter((plain_path(path), size, modified) for path, size, modified in listing)
    listed = spark.createDataFrame([(*version, n) for version, n in times.items()], "source_file string, size long, modified long, times long")
    known = store.read_profile_parts().select(*FILE_KEYS).distinct()
    fresh = {r["source_file"] for r in listed.join(known, FILE_KEYS, "left_anti").select("source_file").toLocalIterator()}
    read = sorted({path for path, _, _ in listing if plain_path(path) in fresh})
    if read:
        log.info("reading %d of %d listed file(s)", len(read), len(listing))
        held = PR.profile_parts(read_frames_of_files(spark, read), ("source_file",))
        # A file without rows leaves a row of its own, so that it is known as well.
        store.add_profile_parts(listed.join(known, FILE_KEYS, "left_anti").join(held, "source_file", "left")
                                .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS}))
    parts = store.read_profile_parts().where("n_rows > 0").join(listed, FILE_KEYS)
    return parts.withColumns({c: F.col(c) * F.col("times") for c in COUNTS}).drop("times"), read


def incremental_profile(spark: SparkSession, store: ManifestStore, patterns: list[str], exclude: list[str] | tuple = ()) -> DataFrame:
    """The media profile of all listed files; equal to ``media_profile(read_frames_csv(...))``."""
    return PR.merge_parts(current_parts(spark, store, patterns, exclude)[0])


def files_of_partitions(parts: DataFrame, write_parts: DataFrame, listing: list[str]) -> list[str]:
    """The listed files that hold a frame of these (cruise, camera) partitions, as often as listed."""
    held = C.with_cruise_camera(parts.where(F.col("n_frames") > 0).select("source_file", "media_path"))
    wanted = {r["source_file"] for r in held.join(write_parts, ["cruise", "camera"], "left_semi").select("source_file").distinct().toLocalIterator()}
    return [f for f in listing if plain_path(f) in wanted]
