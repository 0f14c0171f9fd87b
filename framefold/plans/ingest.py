"""Append-only ingest into the manifest store.

Shape of one run (compare: the reference makes 3 full CSV passes plus one per cruise):

  scan 1  typed CSV rows -> media profile (one frame-volume exchange) -> checkpoint
          -> videos, exclusion counts, id/link count, partition plan (all from the
             checkpointed profile; no further CSV pass)
  scan 2  (only with ``frames=True``) typed CSV rows -> frames for the write set ->
          one rebalance exchange -> every cruise appended in one job

The partition plan gates the run (refuse, or skip what exists). Writes are runs
(``sources.runs``): partitions are claimed, both tables staged, then moved in, ``frames`` first and
``videos`` last, each new (cruise, camera) with one rename. An ingest begins by finishing or undoing the runs
that died before it, so a retry finds every partition whole or absent, and reads no stored frame.
Only files that no run wrote (frames appended directly) are looked into: frames in them whose (cruise, video_id) has no
row in ``videos`` are left out exactly, by (cruise, video_id, frame_index). Frames of stored videos never stand
in the way of a new video that happens to have the same id.
"""
from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import frames as FR
from ..operators import profile as PR
from ..schemas import TYPED_FRAMES, VIDEO_PARTITIONS
from ..session import checkpoint_root
from ..sources import runs as RN
from ..sources.csv_scan import list_frames_csv, read_frames_checked, read_frames_csv, read_frames_of_files
from ..sources.store import ManifestStore
from .incremental import current_parts, files_of_partitions

log = logging.getLogger("framefold.ingest")

KEYS = VIDEO_PARTITIONS

# ---- fixed values: partition status texts of the dry-run plan -------------------
STATUS_NEW = "new"
STATUS_SKIPPED = "EXISTS — would be skipped"
STATUS_REJECTED = "EXISTS — would be rejected"
# (ours) another run has claimed or stored the partition since it was planned
STATUS_TAKEN = "TAKEN — by another run"
# ---------------------------------------------------------------------------------

SUMMARY = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("partitions_total", T.LongType()),
    T.StructField("partitions_written", T.LongType()),
    T.StructField("partitions_skipped", T.LongType()),
    T.StructField("videos_written", T.LongType()),
    T.StructField("frames_written", T.LongType()),
    T.StructField("bad_file", T.LongType()),
    T.StructField("skipped_videos", T.LongType()),
    T.StructField("id_link_nonempty", T.LongType()),
])


class PartitionConflictError(RuntimeError):
    """Some (cruise, camera) partitions already exist and skip_existing is off."""

    def __init__(self, n_conflicts: int, plan: DataFrame):
        self.n_conflicts = n_conflicts
        self.plan = plan                # every partition with its fate; conflicts are ``stored``
        super().__init__(f"refusing to write: {n_conflicts} (cruise, camera) partition(s) already exist "
                         "(all listed in the exception's plan)")


class RejectShareError(RuntimeError):
    """More rows cannot be ingested than the caller allows; nothing was written."""

    def __init__(self, n_rejected: int, n_rows: int, rejected: DataFrame):
        self.n_rejected, self.n_rows = n_rejected, n_rows
        self.rejected = rejected        # source_file, reason, n_rows
        super().__init__(f"{n_rejected} of {n_rows} rows cannot be ingested (by file and reason in the exception's rejected)")


@dataclass
class IngestReport:
    summary: DataFrame          # one row, SUMMARY schema
    plan: DataFrame             # one row per partition: cruise, camera, videos, stored, status
    seconds: dict[str, float] = field(default_factory=dict)     # per phase
    recovered: dict[str, str] = field(default_factory=dict)     # runs that had died -> published, rolled back
    rejected: DataFrame | None = None   # source_file, reason, n_rows of the rows left out; None if all were taken


# ---------------------------------------------------------------- relational pieces
def partition_plan(videos: DataFrame, existing: DataFrame, skip_existing: bool) -> DataFrame:
    """A5 + J5 + F6: videos per partition with its fate."""
    per_part = videos.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("videos"))
    flagged = per_part.join(existing.select(*KEYS).withColumn("_stored", F.lit(True)), KEYS, "left")
    stored = F.coalesce(F.col("_stored"), F.lit(False))
    fate = F.lit(STATUS_SKIPPED if skip_existing else STATUS_REJECTED)
    return flagged.select(*KEYS, "videos", stored.alias("stored"),
                          F.when(stored, fate).otherwise(F.lit(STATUS_NEW)).alias("status"))


def conflicts(parts: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted partitions that are already stored."""
    return parts.select(*KEYS).intersect(existing.select(*KEYS))


def new_partitions(parts: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted partitions not yet stored."""
    return parts.select(*KEYS).distinct().join(existing.select(*KEYS), KEYS, "left_anti")


def videos_to_write(videos: DataFrame, write_parts: DataFrame) -> DataFrame:
    """Videos whose (cruise, camera) is being written. ``write_parts`` is one row
    per partition, so the planner broadcasts it whenever it is small."""
    return videos.join(write_parts.select(*KEYS), KEYS, "left_semi")


def frames_to_write(frames_keyed: DataFrame, write_parts: DataFrame) -> DataFrame:
    """Frames of the videos being written. A frame's path fixes its (cruise,
    camera), so the semi-join runs on the tiny partition list instead of the
    video-volume id list; equal to joining on ``media_path`` with J1's output."""
    return frames_keyed.join(write_parts.select(*KEYS), KEYS, "left_semi")


def leftover_frames(unaccounted: DataFrame, videos: DataFrame) -> DataFrame:
    """(cruise, video_id, frame_index) in files that no run wrote, without a row in ``videos``."""
    stored = unaccounted.select("cruise", "video_id", "frame_index")
    orphans = stored.select("cruise", "video_id").distinct().join(
        videos.select("cruise", "video_id").distinct(), ["cruise", "video_id"], "left_anti")
    return stored.join(orphans, ["cruise", "video_id"], "left_semi").distinct()


# ---------------------------------------------------------------- the run
def _observed_rows(obs: Observation) -> int:
    """Rows counted by an Observation during a write; a write without a metric fails."""
    return int(obs.get["n"])


@contextmanager
def _phase(seconds: dict[str, float], name: str) -> Iterator[None]:
    started = time.perf_counter()
    try:
        yield
    finally:
        seconds[name] = round(seconds.get(name, 0.0) + time.perf_counter() - started, 3)
        log.info("%s: %.1f s", name, seconds[name])


def _pairs(df: DataFrame) -> list[RN.Partition]:
    """A list of partitions: names of folders, a few bytes for each."""
    return [(r["cruise"], r["camera"]) for r in df.select(*KEYS).toLocalIterator()]


def ingest_rows(spark: SparkSession, raw: DataFrame, store_root: str, frames: bool = False,
                skip_existing: bool = False, dry_run: bool = False,
                raw_frames: DataFrame | None = None, claim_seconds: float = RN.CLAIM_SECONDS,
                on_move: RN.OnMove | None = None, max_reject_share: float | None = None,
                profile: DataFrame | None = None,
                frames_of: Callable[[DataFrame], DataFrame] | None = None) -> IngestReport:
    """Ingest typed per-frame rows (``schemas.TYPED_FRAMES``) into the store.

    ``raw_frames`` is the second scan for the frames table (defaults to ``raw``
    itself, i.e. Spark re-reads the source). Raises ``PartitionConflictError``
    on a conflict without ``skip_existing``; its ``plan`` lists every conflict, those with a run that
    is writing now included. A dry run writes nothing, and recovers nothing; its summary counts the partitions and
    videos that a run would write. ``on_move`` is told (source, target) before each rename of the commit.

    With ``max_reject_share``, ``raw`` is a checked scan (``csv_scan.read_frames_checked``): rows with a reason are left
    out and stored in ``rejected`` by the same run, unless they are more than that share of all rows
    (``RejectShareError``). Counting them costs nothing while there are none, else one more scan.

    ``profile`` is the media profile where it is known already, and ``frames_of`` gives the rows for the
    frames table from the partitions to write; with both, ``raw`` is not read.
    """
    checkpoint_root(spark)
    rejects, seen = None, Observation("rows_checked")
    if max_reject_share is not None:
        rejects = raw.filter(F.col("reason").isNotNull())
        columns = [f.name for f in TYPED_FRAMES.fields]
        good = F.col("reason").isNull()
        raw_frames = raw.filter(good).select(*columns)
        raw = raw.observe(seen, F.count_if(~good).alias("rejected")).filter(good).select(*columns)
    seconds: dict[str, float] = {}
    store = ManifestStore(spark, store_root)
    recovered = {}
    if not dry_run:
        with _phase(seconds, "recover"):
            recovered = RN.recover(store.files)

    with _phase(seconds, "profile"):
        profile = (PR.media_profile(raw) if profile is None else profile).checkpoint(eager=True)
        totals = PR.scan_summary(profile).first()

    rejected = None
    if rejects is not None and seen.get["rejected"]:
        with _phase(seconds, "rejected"):
            # One more scan for what is set aside; counts and the stored rows both come from it.
            rejects = rejects.select("source_file", "reason", "record").checkpoint(eager=True)
            rejected = rejects.groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("n_rows")).checkpoint(eager=True)
            n_rejected = int(rejected.agg(F.sum("n_rows")).first()[0])
        n_rows = int(totals.raw_rows) + n_rejected
        if n_rejected > max_reject_share * n_rows:
            raise RejectShareError(n_rejected, n_rows, rejected)

    vids = PR.videos_from_profile(profile, strict_paths=True)
    with _phase(seconds, "plan"):
        plan = partition_plan(vids, store.existing_partitions(), skip_existing).checkpoint(eager=True)
        counts = plan.agg(F.count(F.lit(1)).alias("n"), F.count_if("stored").alias("c")).first()
    n_parts, n_conflicts = int(counts.n), int(counts.c)

    def report(status: str, written_parts: int, videos_n: int, frames_n: int) -> IngestReport:
        row = (status, n_parts, written_parts, n_conflicts if skip_existing else 0, videos_n, frames_n,
               int(totals.bad_file), int(totals.skipped), int(totals.id_link_nonempty))
        return IngestReport(spark.createDataFrame([row], SUMMARY), plan, seconds, recovered, rejected)

    if dry_run:
        fresh = plan.filter(~F.col("stored")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("videos"), F.lit(0)).alias("v")).first()
        return report("dry_run", int(fresh.n), int(fresh.v), 0)

    if n_conflicts and not skip_existing:
        raise PartitionConflictError(n_conflicts, plan)

    if n_parts - n_conflicts == 0:
        log.info("nothing new to write — all %d partition(s) already exist", n_parts)
        return report("nothing_new", 0, 0, 0)

    with store.begin(claim_seconds) as run:
        with _phase(seconds, "claim"):
            wanted = _pairs(plan.filter(~F.col("stored")))
            taken = set(run.claim(wanted))
            # What another run stored between the plan and the claim shows now; nobody can add to it any more.
            taken |= set(wanted) & store.partition_folders()
        if taken:
            lost = spark.createDataFrame(sorted(taken), "cruise string, camera string").withColumn("_taken", F.lit(True))
            plan = plan.join(lost, KEYS, "left").select(
                *KEYS, "videos", (F.col("stored") | F.coalesce("_taken", F.lit(False))).alias("stored"),
                F.when(F.col("_taken"), F.lit(STATUS_TAKEN)).otherwise(F.col("status")).alias("status")).checkpoint(eager=True)
            n_conflicts += len(taken)
            if not skip_existing:
                raise PartitionConflictError(n_conflicts, plan)
            if n_parts - n_conflicts == 0:
                return report("nothing_new", 0, 0, 0)

        write_parts = plan.filter(~F.col("stored")).select(*KEYS)
        vids_out = videos_to_write(vids, write_parts) if n_conflicts else vids

        if rejected is not None:
            run.stage("rejected", rejects.withColumn("run", F.lit(run.id)))

        frames_n = 0
        if frames:
            with _phase(seconds, "frames"):
                if frames_of is not None:
                    raw_frames = frames_of(write_parts)
                keyed = FR.frames_with_keys(raw_frames if raw_frames is not None else raw)
                if n_conflicts or frames_of is not None:
                    keyed = frames_to_write(keyed, write_parts)
                foreign = store.unaccounted_frames({c for c, _ in wanted})
                if foreign is not None:
                    left = leftover_frames(foreign, store.read_videos()).checkpoint(eager=True)
                    if not left.isEmpty():
                        keyed = keyed.join(left, ["cruise", "video_id", "frame_index"], "left_anti")
                obs_f = Observation("frames_written")
                run.stage("frames", keyed, obs_f)
                frames_n = _observed_rows(obs_f)

        with _phase(seconds, "videos"):
            obs_v = Observation("videos_written")
            run.stage("videos", vids_out, obs_v)
            videos_n = _observed_rows(obs_v)
        with _phase(seconds, "commit"):
            run.commit(on_move)
    return report("written", n_parts - n_conflicts, videos_n, frames_n)


def ingest(spark: SparkSession, csv_globs: list[str], store_root: str, exclude: list[str] | tuple = (),
           frames: bool = False, skip_existing: bool = False, dry_run: bool = False,
           headers: str = "detect", max_reject_share: float | None = None, incremental: bool = False) -> IngestReport:
    """CSV globs -> store. The frames table is a second scan of the same files.

    A row that cannot be ingested ends the run, unless ``max_reject_share`` allows some: then such rows are set
    aside with file and reason, and the good rows of the same files are ingested.

    ``incremental`` keeps the profile of every file version in the store: only files not seen before are
    parsed for it, and the frames table reads only files that hold frames of a partition to write.
    """
    if incremental:
        if max_reject_share is not None or headers != "detect" or dry_run:
            raise ValueError("an incremental ingest detects headers, rejects no rows and writes its state")
        store = ManifestStore(spark, store_root)
        parts, _ = current_parts(spark, store, csv_globs, exclude)
        listing = [path for path, _, _ in list_frames_csv(spark, csv_globs, exclude)]

        def frames_of(write_parts: DataFrame) -> DataFrame:
            # Partitions to write have videos, and so files.
            return read_frames_of_files(spark, files_of_partitions(parts, write_parts, listing)).drop("source_file")
        return ingest_rows(spark, spark.createDataFrame([], TYPED_FRAMES), store_root, frames=frames, skip_existing=skip_existing,
                           profile=PR.merge_parts(parts), frames_of=frames_of)
    if max_reject_share is None:
        raw = read_frames_csv(spark, csv_globs, exclude, headers)
    elif headers == "detect":
        raw = read_frames_checked(spark, csv_globs, exclude)
    else:
        raise ValueError("rows can only be rejected where headers are detected")
    return ingest_rows(spark, raw, store_root, frames=frames, skip_existing=skip_existing,
                       dry_run=dry_run, max_reject_share=max_reject_share)
