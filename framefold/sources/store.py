"""The manifest store: Hive-partitioned Parquet ``videos`` (cruise, camera) and
``frames`` (cruise) under one root (S4-S10).

Append-only. No DDL is needed: a missing table reads as an empty DataFrame with
the fixed schema, and the first append creates it. Reads always pass the fixed
schema, so partition values such as ``0042`` stay strings. ``videos`` is written in runs
(``runs.Run``): staged, then moved in with one rename per new partition.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import FRAME_PARTITIONS, FRAMES, PROFILE_PARTS, REJECTED, REJECTED_PARTITIONS, VIDEO_COLUMNS, VIDEO_PARTITIONS, VIDEOS
from . import runs as RN
from .files import StoreFiles

# Rows per Parquet file upper bound: keeps a split hot partition in right-sized files.
MAX_RECORDS_PER_FILE = 5_000_000
LISTING_THREADS = 32


class ManifestStore:
    """A store root: local path, ``hdfs://`` or ``s3a://`` (credentials via
    ``spark.hadoop.fs.s3a.*`` confs supplied by the caller, S10)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.videos_path = f"{self.root}/videos"
        self.frames_path = f"{self.root}/frames"
        self.rejected_path = f"{self.root}/rejected"
        self.files = StoreFiles(spark, self.root)

    # ------------------------------------------------------------ metadata
    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        hp = jvm.org.apache.hadoop.fs.Path(path)
        fs = hp.getFileSystem(conf)
        if not fs.exists(hp):
            return False
        # A table exists once it holds at least one committed data file.
        it = fs.listFiles(hp, True)
        while it.hasNext():
            name = it.next().getPath().getName()
            if not name.startswith((".", "_")):
                return True
        return False

    # ------------------------------------------------------------ reads
    def read_videos(self) -> DataFrame:
        if not self._exists(self.videos_path):
            return self.spark.createDataFrame([], VIDEOS)
        return (self.spark.read.schema(VIDEOS).option("basePath", self.videos_path)
                .parquet(self.videos_path).select(*VIDEO_COLUMNS))

    def read_frames(self) -> DataFrame:
        if not self._exists(self.frames_path):
            return self.spark.createDataFrame([], FRAMES)
        return (self.spark.read.schema(FRAMES).option("basePath", self.frames_path)
                .parquet(self.frames_path).select(*[f.name for f in FRAMES.fields]))

    def read_rejected(self) -> DataFrame:
        """Rows that ingests with a reject share left out: source_file, reason, record, run."""
        if not self._exists(self.rejected_path):
            return self.spark.createDataFrame([], REJECTED)
        return (self.spark.read.schema(REJECTED).option("basePath", self.rejected_path)
                .parquet(self.rejected_path).select(*[f.name for f in REJECTED.fields]))

    # ------------------------------------------------------------ profile state
    def read_profile_parts(self) -> DataFrame:
        """The profile state of every file version that an incremental ingest has read, each once."""
        folders = [f"{self.root}/profile/{n}" for n in self.files.names("profile")]
        if not folders:
            return self.spark.createDataFrame([], PROFILE_PARTS)
        return self.spark.read.schema(PROFILE_PARTS).parquet(*folders).dropDuplicates(["source_file", "size", "modified", "media_path", "media", "media_time"])

    def add_profile_parts(self, parts: DataFrame) -> None:
        """Store the state of newly read files: written aside, then moved in with one rename."""
        name = uuid.uuid4().hex
        parts.select(*PROFILE_PARTS.names).write.parquet(f"{self.root}/_staging/profile-{name}")
        self.files.make_folder("profile")
        if not self.files.move(f"_staging/profile-{name}", f"profile/{name}"):
            raise OSError(f"cannot publish the profile state {name}")

    def existing_partitions(self) -> DataFrame:
        """Distinct stored (cruise, camera), from folder names: no data file is opened and no job runs."""
        kinds = ", ".join(f"{c} string" for c in VIDEO_PARTITIONS)
        return self.spark.createDataFrame(sorted(self.partition_folders()), kinds)

    def partition_folders(self) -> set[RN.Partition]:
        """Stored (cruise, camera) from the names of folders that hold a data file: no job, and current, as a
        partition appears with one rename. Folders are listed in threads; what is held is one name a partition."""
        def holds_data(folder: str) -> bool:
            return any(not n.startswith("_") for n in self.files.names(folder))

        if not self.files.exists("videos"):  # listings may make the root; a dry run must not
            return set()
        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            cruises = [f"videos/{n}" for n in self.files.names("videos") if "=" in n]
            cameras = [f"{d}/{n}" for d, names in zip(cruises, pool.map(self.files.names, cruises), strict=True) for n in names if "=" in n]
            full = [f.split("/")[1:] for f, held in zip(cameras, pool.map(holds_data, cameras), strict=True) if held]
        return {(RN.partition_value(c), RN.partition_value(k)) for c, k in full}

    def unaccounted_frames(self, cruises: Iterable[str]) -> DataFrame | None:
        """Stored frames of these cruises in files that no run of the ledger wrote; None if there are none.

        Decided from file names alone, so where all files are known nothing is read.
        """
        folders = {n: f"frames/{n}" for n in self.files.names("frames") if "=" in n}
        asked = set(cruises)
        wanted = [folders[n] for n in sorted(folders) if RN.partition_value(n) in asked]
        known = RN.known_jobs(self.files)
        foreign = [f"{self.root}/{folder}/{n}" for folder in wanted for n in self.files.names(folder)
                   if not n.startswith("_") and not ((m := RN.JOB.match(n)) and m.group(1) in known)]
        if not foreign:
            return None
        return (self.spark.read.schema(FRAMES).option("basePath", self.frames_path)
                .parquet(*foreign).select(*[f.name for f in FRAMES.fields]))

    # ------------------------------------------------------------ writes
    def begin(self, claim_seconds: float = RN.CLAIM_SECONDS) -> RN.Run:
        """A run for ``with``: claims, staged writes, commit."""
        return RN.Run(self, claim_seconds)

    def write(self, table: str, rows: DataFrame, path: str, observation: Observation | None = None) -> None:
        """Write rows in the layout of ``table`` below ``path``.

        ``videos`` is rebalanced on the partition keys, so each (cruise, camera) lands in few files while a hot
        partition is split across tasks; ``frames`` of every cruise in one job, sorted (video_id, frame_index)
        inside each file. ``observation`` (metric ``n``) counts the rows written; it is attached after
        the shuffle, in the write's result stage, where a re-run map stage cannot count rows twice."""
        from ..operators.frames import write_layout
        if table == "videos":
            keys = VIDEO_PARTITIONS
            laid = (checked_keys(rows.select(*VIDEO_COLUMNS), keys).hint("rebalance", *keys)
                    .sortWithinPartitions(*keys, "video_id"))
        elif table == "rejected":
            keys = REJECTED_PARTITIONS
            laid = rows.select(*[f.name for f in REJECTED.fields]).hint("rebalance")
        else:
            keys = FRAME_PARTITIONS
            laid = write_layout(checked_keys(rows.select(*[f.name for f in FRAMES.fields]), keys))
        (_observed(laid, observation)
         .write.mode("append")
         .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .partitionBy(*keys)
         .parquet(path))

    def append_videos(self, videos: DataFrame, observation: Observation | None = None) -> None:
        """Append rows in a run of their own; a new (cruise, camera) appears whole or not at all."""
        with self.begin() as run:
            run.stage("videos", videos, observation)
            run.commit()

    def append_frames(self, frames: DataFrame, observation: Observation | None = None) -> None:
        """Append rows straight to the table, outside any run (``ingest`` stages them instead)."""
        self.write("frames", frames, self.frames_path, observation)


def _observed(df: DataFrame, observation: Observation | None) -> DataFrame:
    return df if observation is None else df.observe(observation, F.count(F.lit(1)).alias("n"))


def checked_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Empty or null partition values would read back as null: fail the write
    instead. A per-row check inside the write job itself, no extra pass."""
    cols = []
    for c in df.columns:
        if c in keys:
            cols.append(F.when(F.col(c).isNull() | (F.col(c) == ""),
                               F.raise_error(F.lit(f"empty or null partition value in {c}")))
                        .otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
