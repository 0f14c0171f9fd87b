"""Registered queries: one per operator group, each with a DuckDB oracle.

Every query reads the driver tables (through the derived corpus) over their
whole extent. Timestamps leave as TIMESTAMP_NTZ wall clock at UTC so they
compare with DuckDB's naive TIMESTAMP regardless of the session time zone.
"""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import coverage as CV
from ..operators import frames as FR
from ..operators import profile as PR
from ..operators import quality as QU
from ..operators import requests as RQ
from ..plans import incremental as INC
from ..plans import ingest as IN
from ..schemas import CSV_COLUMNS, FRAME_COLUMNS
from ..session import scratch_path
from ..sources import corpus as CO
from ..sources.csv_scan import read_frames_csv, write_frames_csv
from ..sources.store import ManifestStore

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Instants -> UTC wall clock (TIMESTAMP_NTZ); everything else untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(C.utc_wallclock(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- ingest core
def q_ok_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.ok_frames(CO.frames_raw(spark, sf_dir))


def q_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = CO.frames_raw(spark, sf_dir)
    return (raw.select("media_path").distinct()
            .select("media_path", C.cruise_of().alias("cruise"), C.camera_of().alias("camera"),
                    C.basename().alias("media_basename")))


def q_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(PR.videos(CO.frames_raw(spark, sf_dir)))


def q_media_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.media_profile(CO.frames_raw(spark, sf_dir))


def q_excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.exclusion_counts(PR.media_profile(CO.frames_raw(spark, sf_dir)))


def q_id_link_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.id_link_count(PR.media_profile(CO.frames_raw(spark, sf_dir)))


def q_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.scan_summary(PR.media_profile(CO.frames_raw(spark, sf_dir)))


def q_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.partitions(PR.videos(CO.frames_raw(spark, sf_dir)))


def q_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(FR.frames_sorted(CO.frames_raw(spark, sf_dir)))


# ---------------------------------------------------------------- CSV source
LEGACY_CAMERAS = ("Cam4", "Cam5")  # exports written with the old 6-column header


def _csv_corpus(spark: SparkSession, sf_dir: str) -> str:
    """Write the whole corpus as per-frame CSV exports in two header variants."""
    root = scratch_path(spark, "csv")
    raw = CO.frames_raw(spark, sf_dir)
    legacy = F.split(F.col("media_path"), "/").getItem(4).isin(*LEGACY_CAMERAS)
    write_frames_csv(raw.filter(~legacy), f"{root}/full")
    write_frames_csv(raw.filter(legacy), f"{root}/legacy",
                     columns=["media_path", "media", "media_time", "frame", "times", "status"])
    return root


def q_scan_frames_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _csv_corpus(spark, sf_dir)
    return read_frames_csv(spark, [f"{root}/full/*.csv", f"{root}/legacy/*.csv"])


def q_scan_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _csv_corpus(spark, sf_dir)
    return read_frames_csv(spark, [f"{root}/*/*.csv"], exclude=["*/legacy/part-*.csv"])


def q_scan_header_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports with the full, the old 6-column, a reordered and an extended header, one per camera group."""
    root = scratch_path(spark, "variants")
    raw = CO.frames_raw(spark, sf_dir).withColumn("remark", F.concat(F.lit("seen, "), "media"))
    camera = F.split(F.col("media_path"), "/").getItem(4)
    old = ["media_path", "media", "media_time", "frame", "times", "status"]
    full = [*old, "id", "link"]
    for name, cameras, columns in (("full", ["Cam1"], full), ("old", [*LEGACY_CAMERAS], old), ("turned", ["Cam2"], full[::-1]),
                                   ("extra", ["Cam3"], ["remark", *full])):
        write_frames_csv(raw.filter(camera.isin(cameras)), f"{root}/{name}", columns=columns)
    return read_frames_csv(spark, [f"{root}/*/*.csv"])


# ---------------------------------------------------------------- store and ingest
def _seeded_store(spark: SparkSession, sf_dir: str, label: str, with_frames: bool = True):
    """A fresh store holding the seeded partitions, as if ingested earlier."""
    raw = CO.frames_raw(spark, sf_dir)
    store = ManifestStore(spark, scratch_path(spark, label))
    store.append_videos(PR.videos(raw).filter(CO.seeded_partition()))
    if with_frames:
        store.append_frames(FR.frames_with_keys(raw).filter(CO.seeded_partition()))
    return store, raw


def q_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ManifestStore(spark, scratch_path(spark, "roundtrip"))
    store.append_videos(PR.videos(CO.frames_raw(spark, sf_dir)))
    return comparable(store.read_videos())


def q_frames_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ManifestStore(spark, scratch_path(spark, "frames"))
    IN.ingest_rows(spark, CO.frames_raw(spark, sf_dir), store.root, frames=True)
    return comparable(store.read_frames())


def q_existing_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _seeded_store(spark, sf_dir, "existing", with_frames=False)
    return store.existing_partitions()


def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "conflicts", with_frames=False)
    return IN.conflicts(PR.partitions(PR.videos(raw)), store.existing_partitions())


def q_new_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "newparts", with_frames=False)
    return IN.new_partitions(PR.videos(raw), store.existing_partitions())


def q_videos_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "v2w", with_frames=False)
    # Partitions and videos both come from the profile; it is worked out once, as the ingest does.
    vids = PR.videos_from_profile(PR.media_profile(raw).checkpoint(eager=True))
    return comparable(IN.videos_to_write(vids, IN.new_partitions(vids, store.existing_partitions())))


def q_frames_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "f2w", with_frames=False)
    new_parts = IN.new_partitions(PR.videos(raw), store.existing_partitions())
    return comparable(IN.frames_to_write(FR.frames_with_keys(raw), new_parts).select(*FRAME_COLUMNS))


def q_dry_run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "dryrun", with_frames=False)
    return IN.ingest_rows(spark, raw, store.root, frames=True, dry_run=True).plan


def q_dry_run_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "dryskip", with_frames=False)
    return IN.ingest_rows(spark, raw, store.root, dry_run=True, skip_existing=True).plan


def q_dry_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "drysum", with_frames=False)
    return IN.ingest_rows(spark, raw, store.root, dry_run=True, skip_existing=True).summary


def q_frames_one_cruise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one cruise's frames read back from the store, in order."""
    store = ManifestStore(spark, scratch_path(spark, "onecruise"))
    IN.ingest_rows(spark, CO.frames_raw(spark, sf_dir), store.root, frames=True)
    return comparable(FR.one_cruise(store.read_frames(), "CRUISE_07"))


def q_frames_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored frame after a real ingest beside seeded partitions."""
    store, raw = _seeded_store(spark, sf_dir, "ingested")
    IN.ingest_rows(spark, raw, store.root, frames=True, skip_existing=True)
    return comparable(store.read_frames())


def q_retry_after_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that died after half of each video's frames and before ``videos``, then run again."""
    raw = CO.frames_raw(spark, sf_dir)
    store = ManifestStore(spark, scratch_path(spark, "retry"))
    store.append_frames(FR.frames_table(raw).filter("frame_index % 2 = 0"))
    IN.ingest_rows(spark, raw, store.root, frames=True)
    return comparable(store.read_frames())


STOP_AFTER_RENAMES = 40


def _whole_store(store: ManifestStore) -> DataFrame:
    """Every stored video with the frames that are stored of it."""
    frames = store.read_frames().groupBy("cruise", "video_id").agg(F.count(F.lit(1)).alias("n_stored_frames"))
    return comparable(store.read_videos().join(frames, ["cruise", "video_id"], "full"))


def q_retry_inside_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped between two renames of its commit, then the same ingest again."""
    class Stopped(RuntimeError):
        pass

    moved: list[str] = []

    def stop(source: str, target: str) -> None:
        if len(moved) == STOP_AFTER_RENAMES:
            raise Stopped
        moved.append(target)

    raw = CO.frames_raw(spark, sf_dir)
    store = ManifestStore(spark, scratch_path(spark, "inside"))
    try:
        IN.ingest_rows(spark, raw, store.root, frames=True, on_move=stop)
    except Stopped:
        IN.ingest_rows(spark, raw, store.root, frames=True, skip_existing=True)
    return _whole_store(store)


def q_concurrent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingests of the whole corpus into one store at the same time."""
    store = ManifestStore(spark, scratch_path(spark, "twice"))
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(IN.ingest_rows, spark, CO.frames_raw(spark, sf_dir), store.root, frames=True, skip_existing=True) for _ in range(2)]
        for run in runs:
            run.result()
    return _whole_store(store)


def q_incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile after a scan of some exports, then of all: the second reads only those that are new."""
    root = scratch_path(spark, "incremental")
    raw = CO.frames_raw(spark, sf_dir)
    camera = F.split(F.col("media_path"), "/").getItem(4)
    write_frames_csv(raw.filter(camera.isin(*CO.SEEDED_CAMERAS)), f"{root}/first")
    write_frames_csv(raw.filter(~camera.isin(*CO.SEEDED_CAMERAS)), f"{root}/later")
    store = ManifestStore(spark, f"{root}/store")
    INC.current_parts(spark, store, [f"{root}/first/*.csv"])
    return INC.incremental_profile(spark, store, [f"{root}/*/*.csv"])


def q_ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports with bad records: what is set aside, by reason, and what is stored."""
    root = scratch_path(spark, "faulty")
    CO.faulty_exports(CO.frames_raw(spark, sf_dir), CSV_COLUMNS).write.partitionBy("file").text(f"{root}/exports")
    store = ManifestStore(spark, f"{root}/store")
    IN.ingest(spark, [f"{root}/exports/*/*.txt"], store.root, frames=True, max_reject_share=0.1)
    counts = store.read_rejected().groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))
    for kind, table in (("stored frames", store.read_frames()), ("stored videos", store.read_videos())):
        counts = counts.unionByName(table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(kind).alias("kind"), "n_rows"))
    return counts


def q_ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, raw = _seeded_store(spark, sf_dir, "ingest")
    return IN.ingest_rows(spark, raw, store.root, frames=True, skip_existing=True).summary


# ---------------------------------------------------------------- requests
def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RQ.resolve_requests(CO.requests(spark, sf_dir), PR.videos(CO.frames_raw(spark, sf_dir)))


def q_resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


def q_request_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RQ.status_counts(RQ.resolve_distinct(CO.requests(spark, sf_dir), PR.videos(CO.frames_raw(spark, sf_dir))))


def q_video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RQ.video_metadata(PR.videos(CO.frames_raw(spark, sf_dir)))


def q_video_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RQ.video_lookup(CO.requests(spark, sf_dir), PR.videos(CO.frames_raw(spark, sf_dir)))


def q_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RQ.neighbors(_resolved(spark, sf_dir))


def _seeded_cache(raw: DataFrame) -> DataFrame:
    """Frames already in the cache: the PNGs of every frame of the seeded partitions."""
    return (FR.frames_with_keys(raw).filter(CO.seeded_partition())
            .select("video_id", "frame_index", F.lit("png").alias("format")))


def q_cache_miss_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = CO.frames_raw(spark, sf_dir)
    resolved = RQ.resolve_distinct(CO.requests(spark, sf_dir), PR.videos(raw))
    return RQ.cache_miss_plan(resolved, _seeded_cache(raw))


# ---------------------------------------------------------------- quality
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = CO.faulty(CO.frames_raw(spark, sf_dir))
    store = ManifestStore(spark, scratch_path(spark, "quality"))
    kept = CO.frames_raw(spark, sf_dir).filter(CO.order_key() % CO.UNSTORED_EVERY != 0)
    store.append_frames(FR.frames_table(kept))
    # Three checks roll up from the profile; it is worked out once, as the ingest does.
    profile = PR.media_profile(raw).checkpoint(eager=True)
    return QU.quality_report(raw, profile, PR.videos_from_profile(profile), store.read_frames())


def q_frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing range of the long videos."""
    return CV.missing_ranges(CV.frame_words(CO.reels(CO.frames_raw(spark, sf_dir))))


def q_frame_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.frame_coverage(CV.frame_words(CO.frames_raw(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "ok_frames": q_ok_frames,
    "path_parts": q_path_parts,
    "media_profile": q_media_profile,
    "videos": q_videos,
    "excluded_counts": q_excluded_counts,
    "id_link_count": q_id_link_count,
    "scan_summary": q_scan_summary,
    "partitions": q_partitions,
    "frames": q_frames,
    "scan_frames_csv": q_scan_frames_csv,
    "scan_exclude": q_scan_exclude,
    "store_roundtrip": q_store_roundtrip,
    "frames_store": q_frames_store,
    "existing_partitions": q_existing_partitions,
    "conflicts": q_conflicts,
    "new_partitions": q_new_partitions,
    "videos_to_write": q_videos_to_write,
    "frames_to_write": q_frames_to_write,
    "dry_run_plan": q_dry_run_plan,
    "ingest_summary": q_ingest_summary,
    "resolve_requests": q_resolve_requests,
    "request_status_counts": q_request_status_counts,
    "video_metadata": q_video_metadata,
    "video_lookup": q_video_lookup,
    "neighbors": q_neighbors,
    "cache_miss_plan": q_cache_miss_plan,
    "quality_report": q_quality_report,
    "frame_gaps": q_frame_gaps,
    "frame_coverage": q_frame_coverage,
    "scan_header_variants": q_scan_header_variants,
    "frames_one_cruise": q_frames_one_cruise,
    "dry_run_skip": q_dry_run_skip,
    "dry_run_summary": q_dry_run_summary,
    "retry_after_crash": q_retry_after_crash,
    "frames_ingested": q_frames_ingested,
    "ingest_quarantine": q_ingest_quarantine,
    "incremental_profile": q_incremental_profile,
    "retry_inside_commit": q_retry_inside_commit,
    "concurrent_ingest": q_concurrent_ingest,
}


# ---------------------------------------------------------------- DuckDB oracle
_CTE_RAW = f"frames_raw AS ({CO.FRAMES_RAW_SQL})"
_CTE_OK = "ok AS (SELECT * FROM frames_raw WHERE frame IS NOT NULL AND NOT contains(media_path, '/skip/'))"
# Third and fourth part from the end of the path; the list counts from 1 and is null outside.
_CRUISE_SQL = "nullif(string_split(media_path, '/')[-4], '')"
_CAMERA_SQL = "nullif(string_split(media_path, '/')[-3], '')"
_CTE_VIDEOS = f"""videos AS (
  SELECT arg_min(media, frame) AS video_id, media_path, count(*) AS frame_count,
         CAST(arg_min(media_time, frame) AS TIMESTAMP) AS media_time,
         {_CRUISE_SQL} AS cruise, {_CAMERA_SQL} AS camera
  FROM ok GROUP BY media_path)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE: dict[str, str] = {
    "ok_frames": _with(_CTE_RAW) + "SELECT * FROM frames_raw WHERE frame IS NOT NULL AND NOT contains(media_path, '/skip/')",
    "path_parts": _with(_CTE_RAW) + f"""
SELECT media_path, {_CRUISE_SQL} AS cruise, {_CAMERA_SQL} AS camera,
       regexp_extract(media_path, '([^/]+)$', 1) AS media_basename
FROM (SELECT DISTINCT media_path FROM frames_raw)""",
    "media_profile": _with(_CTE_RAW) + """
SELECT media_path, arg_min(media, frame) AS media, arg_min(media_time, frame) AS media_time,
       count(*) AS n_rows, count(frame) AS n_frames, count(*) FILTER (WHERE frame IS NULL) AS n_sentinel,
       min(frame) AS min_frame, max(frame) AS max_frame,
       count(*) FILTER (WHERE (id IS NOT NULL AND id <> '') OR (link IS NOT NULL AND link <> '')) AS n_id_link
FROM frames_raw GROUP BY media_path""",
    "videos": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS) + "SELECT * FROM videos",
    "excluded_counts": _with(_CTE_RAW) + """
SELECT count(DISTINCT CASE WHEN frame IS NULL AND NOT contains(media_path, '/skip/') THEN media_path END) AS bad_file,
       count(DISTINCT CASE WHEN contains(media_path, '/skip/') THEN media_path END) AS skipped
FROM frames_raw""",
    "id_link_count": _with(_CTE_RAW) + """
SELECT count(*) AS id_link_nonempty FROM frames_raw
WHERE (id IS NOT NULL AND id <> '') OR (link IS NOT NULL AND link <> '')""",
    "scan_summary": _with(_CTE_RAW, _CTE_OK) + """
SELECT (SELECT count(*) FROM frames_raw) AS raw_rows,
       (SELECT count(DISTINCT media_path) FROM frames_raw WHERE frame IS NULL AND NOT contains(media_path, '/skip/')) AS bad_file,
       (SELECT count(DISTINCT media_path) FROM frames_raw WHERE contains(media_path, '/skip/')) AS skipped,
       (SELECT count(*) FROM frames_raw WHERE (id IS NOT NULL AND id <> '') OR (link IS NOT NULL AND link <> '')) AS id_link_nonempty,
       (SELECT count(DISTINCT media_path) FROM ok) AS videos,
       (SELECT count(*) FROM ok) AS frames""",
    "partitions": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS) + "SELECT DISTINCT cruise, camera FROM videos ORDER BY cruise, camera",
    "frames": _with(_CTE_RAW, _CTE_OK) + f"""
SELECT media AS video_id, frame AS frame_index, CAST(times AS TIMESTAMP) AS frame_time, status,
       {_CRUISE_SQL} AS cruise
FROM ok ORDER BY cruise, video_id, frame_index""",
}

_CTE_REQ = f"requests AS ({CO.REQUESTS_SQL})"
_CTE_OKK = f"okk AS (SELECT *, {_CRUISE_SQL} AS cruise, {_CAMERA_SQL} AS camera FROM ok)"
_SEEDED = CO.SEEDED_SQL
_CAM_IN_PATH = "split_part(media_path, '/', 5)"
_ISO_SQL = ("strftime(media_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(media_time) % 1000000 = 0 THEN '' "
            "ELSE '.' || lpad(CAST(epoch_us(media_time) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'")
_CTE_RESOLVED = """resolved AS (
  SELECT r.request_id, r.video_id, r.frame_index, coalesce(r.format, 'png') AS format,
         CASE WHEN coalesce(r.format, 'png') NOT IN ('png', 'jpeg') THEN 400
              WHEN v.video_id IS NULL THEN 404
              WHEN r.frame_index < 0 OR r.frame_index >= v.frame_count THEN 416
              ELSE 200 END AS status_code,
         v.media_path AS v_path, v.frame_count AS v_count
  FROM requests r LEFT JOIN videos v ON r.video_id = v.video_id)"""
_SCAN_CSV_SELECT = f"""SELECT media_path, media, media_time, frame, times, status,
       CASE WHEN {_CAM_IN_PATH} IN ('Cam4', 'Cam5') THEN NULL ELSE nullif(id, '') END AS id,
       CASE WHEN {_CAM_IN_PATH} IN ('Cam4', 'Cam5') THEN NULL ELSE nullif(link, '') END AS link
FROM frames_raw"""
_KEY_SQL = "video_id || '_' || CAST(frame_index AS VARCHAR) || '.' || CASE format WHEN 'png' THEN 'png' ELSE 'jpg' END"

ORACLE.update({
    "scan_frames_csv": _with(_CTE_RAW) + _SCAN_CSV_SELECT,
    "scan_exclude": _with(_CTE_RAW) + _SCAN_CSV_SELECT + f" WHERE {_CAM_IN_PATH} NOT IN ('Cam4', 'Cam5')",
    "store_roundtrip": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS) + "SELECT * FROM videos",
    "frames_store": _with(_CTE_RAW, _CTE_OK) + f"""
SELECT media AS video_id, frame AS frame_index, CAST(times AS TIMESTAMP) AS frame_time, status,
       {_CRUISE_SQL} AS cruise FROM ok""",
    "existing_partitions": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS)
    + f"SELECT DISTINCT cruise, camera FROM videos WHERE {_SEEDED}",
    "conflicts": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS)
    + f"SELECT cruise, camera FROM videos INTERSECT SELECT cruise, camera FROM videos WHERE {_SEEDED}",
    "new_partitions": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS)
    + f"SELECT cruise, camera FROM videos EXCEPT SELECT cruise, camera FROM videos WHERE {_SEEDED}",
    "videos_to_write": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS) + f"SELECT * FROM videos WHERE NOT ({_SEEDED})",
    "frames_to_write": _with(_CTE_RAW, _CTE_OK, _CTE_OKK) + f"""
SELECT media AS video_id, frame AS frame_index, CAST(times AS TIMESTAMP) AS frame_time, status, cruise
FROM okk WHERE NOT ({_SEEDED})""",
    "dry_run_plan": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS) + f"""
SELECT cruise, camera, count(*) AS videos, bool_or({_SEEDED}) AS stored,
       CASE WHEN bool_or({_SEEDED}) THEN 'EXISTS — would be rejected' ELSE 'new' END AS status
FROM videos GROUP BY cruise, camera""",
    "ingest_summary": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS, _CTE_OKK) + f"""
SELECT 'written' AS status,
       (SELECT count(*) FROM (SELECT DISTINCT cruise, camera FROM videos)) AS partitions_total,
       (SELECT count(*) FROM (SELECT DISTINCT cruise, camera FROM videos WHERE NOT ({_SEEDED}))) AS partitions_written,
       (SELECT count(*) FROM (SELECT DISTINCT cruise, camera FROM videos WHERE {_SEEDED})) AS partitions_skipped,
       (SELECT count(*) FROM videos WHERE NOT ({_SEEDED})) AS videos_written,
       (SELECT count(*) FROM okk WHERE NOT ({_SEEDED})) AS frames_written,
       (SELECT count(DISTINCT media_path) FROM frames_raw
         WHERE frame IS NULL AND NOT contains(media_path, '/skip/')) AS bad_file,
       (SELECT count(DISTINCT media_path) FROM frames_raw WHERE contains(media_path, '/skip/')) AS skipped_videos,
       (SELECT count(*) FROM frames_raw
         WHERE (id IS NOT NULL AND id <> '') OR (link IS NOT NULL AND link <> '')) AS id_link_nonempty""",
    "resolve_requests": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS, _CTE_REQ, _CTE_RESOLVED) + """
SELECT request_id, video_id, frame_index, format, status_code,
       CASE status_code
            WHEN 400 THEN 'unknown format: ''' || format || ''' (allowed: png, jpeg)'
            WHEN 404 THEN 'video_id=''' || video_id || ''' not in manifest'
            WHEN 416 THEN 'frame_index=' || CAST(frame_index AS VARCHAR) || ' out of range for video_id='''
                          || video_id || ''' (frame_count=' || CAST(v_count AS VARCHAR) || ')'
       END AS detail,
       CASE WHEN status_code = 200 THEN CASE format WHEN 'png' THEN 'image/png' ELSE 'image/jpeg' END END
         AS content_type,
       v_path AS media_path, v_count AS frame_count
FROM resolved""",
    "request_status_counts": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS, _CTE_REQ, _CTE_RESOLVED)
    + "SELECT status_code, count(*) AS n_requests FROM resolved GROUP BY status_code",
    "video_metadata": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS) + f"""
SELECT video_id, regexp_extract(media_path, '[^/]+$', 0) AS media_basename, frame_count,
       frame_count - 1 AS last_frame_index, {_ISO_SQL} AS media_time, cruise, camera
FROM videos""",
    "video_lookup": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS, _CTE_REQ) + f"""
SELECT i.video_id, regexp_extract(v.media_path, '[^/]+$', 0) AS media_basename, v.frame_count,
       v.frame_count - 1 AS last_frame_index, {_ISO_SQL.replace('media_time', 'v.media_time')} AS media_time,
       v.cruise, v.camera,
       CASE WHEN v.video_id IS NULL THEN 404 ELSE 200 END AS status_code,
       CASE WHEN v.video_id IS NULL THEN 'video_id=''' || i.video_id || ''' not in manifest' END AS detail
FROM (SELECT DISTINCT video_id FROM requests) i LEFT JOIN videos v ON i.video_id = v.video_id""",
    "neighbors": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS, _CTE_REQ, _CTE_RESOLVED) + """
SELECT request_id, video_id, frame_index, o.off AS "offset", frame_index + o.off AS neighbor_index,
       '/frames/' || video_id || '/' || CAST(frame_index + o.off AS VARCHAR) || '?format=' || format AS neighbor_url,
       video_id || '_' || CAST(frame_index + o.off AS VARCHAR) || '.'
         || CASE format WHEN 'png' THEN 'png' ELSE 'jpg' END AS neighbor_key
FROM resolved CROSS JOIN (VALUES (-5), (-1), (1), (5)) o(off)
WHERE status_code = 200 AND frame_index + o.off >= 0 AND frame_index + o.off < v_count""",
    "cache_miss_plan": _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS, _CTE_REQ, _CTE_RESOLVED, _CTE_OKK) + f""",
wanted AS (
  SELECT {_KEY_SQL} AS cache_key, video_id, frame_index, format, v_path AS media_path, count(*) AS n_requests
  FROM resolved WHERE status_code = 200 GROUP BY ALL)
SELECT * FROM wanted w WHERE NOT EXISTS (
  SELECT 1 FROM okk WHERE {_SEEDED} AND okk.media || '_' || CAST(okk.frame AS VARCHAR) || '.png' = w.cache_key)""",
    "quality_report": _with(f"clean_raw AS ({CO.FRAMES_RAW_SQL})", f"frames_raw AS ({CO.FAULTY_SQL})", _CTE_OK,
                            _CTE_VIDEOS.replace("CAST(arg_min(media_time, frame) AS TIMESTAMP)", "TRY_CAST(arg_min(media_time, frame) AS TIMESTAMP)"),
                            """stored AS (SELECT DISTINCT media FROM clean_raw
  WHERE frame IS NOT NULL AND NOT contains(media_path, '/skip/') AND CAST(substr(media, 5) AS BIGINT) % 61 <> 0)""") + """
SELECT 'duplicate_video_id' AS "check",
       (SELECT count(*) FROM (SELECT video_id FROM videos GROUP BY video_id HAVING count(*) > 1)) AS n_items
UNION ALL SELECT 'duplicate_path_frame',
       (SELECT count(*) FROM (SELECT media_path, frame FROM ok GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'null_media_time', (SELECT count(*) FROM videos WHERE media_time IS NULL)
UNION ALL SELECT 'frame_count_mismatch',
       (SELECT count(*) FROM (SELECT media_path FROM ok GROUP BY media_path HAVING count(*) <> max(frame) + 1
          OR count(DISTINCT frame) FILTER (WHERE frame >= 0) <> max(frame) + 1))
UNION ALL SELECT 'unparseable_path', (SELECT count(*) FROM videos WHERE cruise IS NULL)
UNION ALL SELECT 'video_without_frames',
       (SELECT count(*) FROM videos v WHERE NOT EXISTS (SELECT 1 FROM stored WHERE stored.media = v.video_id))""",
})

_WHOLE_STORE = _with(_CTE_RAW, _CTE_OK, _CTE_VIDEOS, _CTE_OKK) + """
SELECT v.*, n_stored_frames FROM videos v
JOIN (SELECT cruise, media, count(*) AS n_stored_frames FROM okk GROUP BY ALL) f ON f.cruise = v.cruise AND f.media = v.video_id"""

ORACLE.update({
    "incremental_profile": ORACLE["media_profile"],
    "ingest_quarantine": _with(_CTE_RAW, """kinds AS (
  SELECT media_path, frame, CASE WHEN okey % 67 = 0 OR okey % 73 = 0 THEN 'malformed record'
                                 WHEN okey % 53 = 0 AND frame IS NOT NULL THEN 'frame is not a whole number'
                                 WHEN frame IS NOT NULL AND NOT contains(media_path, '/skip/') THEN 'stored frames' END AS kind
  FROM (SELECT *, CAST(substr(media, 5) AS BIGINT) AS okey FROM frames_raw))""") + """
SELECT kind, count(*) AS n_rows FROM kinds WHERE kind IS NOT NULL GROUP BY kind
UNION ALL SELECT 'stored videos', count(DISTINCT media_path) FROM kinds WHERE kind = 'stored frames'""",
    "retry_inside_commit": _WHOLE_STORE,
    "concurrent_ingest": _WHOLE_STORE,
    "frame_gaps": _with(_CTE_RAW, f"reels AS ({CO.REELS_SQL})",
                        "listed AS (SELECT DISTINCT media_path, frame FROM reels WHERE frame >= 0 AND NOT contains(media_path, '/skip/'))",
                        "placed AS (SELECT *, lag(frame, 1, -1) OVER (PARTITION BY media_path ORDER BY frame) AS before FROM listed)") + """
SELECT media_path, before + 1 AS first_missing, frame - 1 AS last_missing, frame - before - 1 AS n_missing
FROM placed WHERE frame > before + 1""",
    "frame_coverage": _with(_CTE_RAW, _CTE_OK) + """
SELECT media_path, count(*) AS n_rows, count(DISTINCT frame) AS n_distinct, max(frame) AS last_frame,
       max(frame) + 1 - count(DISTINCT frame) AS n_missing, count(*) - count(DISTINCT frame) AS n_duplicate
FROM ok GROUP BY media_path""",
    "scan_header_variants": ORACLE["scan_frames_csv"],
    "frames_one_cruise": ORACLE["frames_store"] + f" WHERE {_CRUISE_SQL} = 'CRUISE_07'",
    "frames_ingested": ORACLE["frames_store"],
    "retry_after_crash": ORACLE["frames_store"],
    "dry_run_skip": ORACLE["dry_run_plan"].replace("EXISTS — would be rejected", "EXISTS — would be skipped"),
    "dry_run_summary": ORACLE["ingest_summary"].replace("'written' AS status", "'dry_run' AS status")
    .replace("(SELECT count(*) FROM okk WHERE NOT (" + _SEEDED + ")) AS frames_written", "0 AS frames_written"),
})
