"""framefold — a Spark-native frame index for instrument video collections.

Per-frame CSV exports are scanned, profiled and folded into a one-row-per-video
manifest (``videos``) and a sorted per-frame table (``frames``), both stored as
Hive-partitioned Parquet with append-only, skip-what-exists ingest. Tables of
frame requests are resolved and planned as distributed jobs.

Layout:
  functions/   Column expressions (no UDFs): predicates, path parsing, time, keys
  sources/     CSV scan, Parquet store, derived corpus
  operators/   DataFrame operators: media profile, videos, frames, requests, quality
  plans/       ingest orchestration and the registered query catalog
"""

__version__ = "0.1.0"

from .operators.frames import frames_sorted, frames_table, one_cruise  # noqa: E402
from .operators.profile import media_profile, partitions, scan_summary, videos  # noqa: E402
from .operators.quality import quality_report  # noqa: E402
from .operators.requests import (  # noqa: E402
    cache_miss_plan, neighbors, resolve_distinct, resolve_requests, video_lookup, video_metadata)
from .plans.ingest import IngestReport, PartitionConflictError, ingest, ingest_rows  # noqa: E402
from .session import build_session  # noqa: E402
from .sources.csv_scan import HeaderError, NoInputError, read_frames_csv  # noqa: E402
from .sources.store import ManifestStore  # noqa: E402

__all__ = [
    "build_session", "read_frames_csv", "ingest", "ingest_rows", "IngestReport", "PartitionConflictError",
    "NoInputError", "HeaderError", "ManifestStore", "media_profile", "videos", "scan_summary", "partitions",
    "frames_table", "frames_sorted", "one_cruise", "resolve_requests", "resolve_distinct", "video_lookup",
    "video_metadata", "neighbors", "cache_miss_plan", "quality_report",
]
