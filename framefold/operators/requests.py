"""Tables of frame requests resolved against the manifest (R1, J4, F7, F8, H12s),
public video metadata (P3), prefetch neighbours (R5) and the cache-miss plan (R4).

The reference answers one HTTP request at a time from an in-memory dict; here
whole tables of requests are resolved at once. Requests first collapse to
distinct (video_id, frame_index, format) with map-side partial aggregation, so
a hot video reaches the manifest join as a bounded number of rows; AQE
broadcasts the manifest when its measured size allows and sort-merges
otherwise. Per-request output joins back on the full key with plain shuffles
on both sides, where AQE's skew join splits a hot key's requests.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# ---- fixed values: response texts of the request contract ---------------------------
DETAIL_BAD_FORMAT = "unknown format: {fmt} (allowed: png, jpeg)"
DETAIL_NOT_FOUND = "video_id={vid} not in manifest"
DETAIL_OUT_OF_RANGE = "frame_index={idx} out of range for video_id={vid} (frame_count={n})"
DETAIL_EXTRACTION_FAILED = "frame extraction failed"
STATUS_OK, STATUS_BAD_FORMAT, STATUS_NOT_FOUND, STATUS_OUT_OF_RANGE, STATUS_FAILED = 200, 400, 404, 416, 500
NEIGHBOR_WINDOW = "1,5"
# --------------------------------------------------------------------------------------


def py_repr(s: Column) -> Column:
    """Python's repr() of a str, for the common cases: single quotes unless the text
    holds a single quote and no double quote; backslashes doubled."""
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    use_double = s.contains("'") & ~s.contains('"')
    return F.when(use_double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def unique_videos(videos: DataFrame) -> DataFrame:
    """One row per ``video_id`` (H8): a duplicate id would fan a left join out.
    Deterministic pick: the row with the smallest ``media_path``. The output is
    hash-partitioned on ``video_id``, which the following join reuses."""
    cols = [c for c in videos.columns if c != "video_id"]
    picked = videos.groupBy("video_id").agg(
        F.min_by(F.struct(*cols), F.col("media_path")).alias("v"))
    return picked.select("video_id", *[F.col(f"v.{c}").alias(c) for c in cols])


def lookup(ids: DataFrame, videos: DataFrame) -> DataFrame:
    """``ids`` left-joined with the manifest; ``found`` tells hit from miss."""
    v = unique_videos(videos).withColumn("_hit", F.lit(True))
    return (ids.join(v, "video_id", "left")
            .withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


def _metadata_columns() -> list[tuple[str, Column]]:
    """P3 fields after ``video_id``; ``media_path`` stays internal."""
    return [
        ("media_basename", C.basename()),
        ("frame_count", F.col("frame_count")),
        ("last_frame_index", C.last_frame_index()),
        ("media_time", C.iso8601_utc("media_time")),
        ("cruise", F.col("cruise")),
        ("camera", F.col("camera")),
    ]


def video_metadata(videos: DataFrame) -> DataFrame:
    """What ``GET /videos/{id}`` shows."""
    return videos.select("video_id", *[expr.alias(name) for name, expr in _metadata_columns()])


def video_lookup(ids: DataFrame, videos: DataFrame) -> DataFrame:
    """``GET /videos/{id}`` over a table of ids: metadata, or 404 with detail.
    One pass: distinct ids (partial aggregation absorbs hot ids), one join."""
    hits = lookup(ids.select("video_id").distinct(), videos)
    found = F.col("found")
    return hits.select(
        "video_id",
        *[F.when(found, expr).alias(name) for name, expr in _metadata_columns()],
        F.when(found, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_NOT_FOUND)).alias("status_code"),
        F.when(~found, F.format_string(DETAIL_NOT_FOUND.replace("{vid}", "%s"),
                                       py_repr(F.col("video_id")))).alias("detail"),
    )


TRIPLE = ["video_id", "frame_index", "format"]


def resolve_distinct(requests: DataFrame, videos: DataFrame) -> DataFrame:
    """R1 per distinct (video_id, frame_index, format), with ``n_requests``.

    The status depends on nothing else, so requests collapse first (map-side
    partial aggregation): a video requested by a third of all requests reaches
    the manifest join as at most one row per distinct index and format.
    Status order is the contract's: 400 bad format, then 404 unknown video,
    then 416 out of range, else 200 (extraction pending).
    """
    req = requests.select("video_id", "frame_index", C.effective_format("format").alias("format"))
    triples = req.groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("n_requests"))
    return graded(lookup(triples, videos)).select(*TRIPLE, *RESOLVED, "n_requests")


RESOLVED = ["status_code", "detail", "content_type", "media_path", "frame_count"]


def graded(joined: DataFrame) -> DataFrame:
    """Looked-up requests with status_code, detail and content_type; manifest columns only where found."""
    vid, idx, n = F.col("video_id"), F.col("frame_index"), F.col("frame_count")
    status = (F.when(~C.format_allowed("format"), F.lit(STATUS_BAD_FORMAT))
              .when(~F.col("found"), F.lit(STATUS_NOT_FOUND))
              # a null index (or count) is out of range, never servable
              .when(~F.coalesce(C.index_in_range(idx, n), F.lit(False)), F.lit(STATUS_OUT_OF_RANGE))
              .otherwise(F.lit(STATUS_OK)))
    detail = (F.when(status == STATUS_BAD_FORMAT,
                     F.format_string(DETAIL_BAD_FORMAT.replace("{fmt}", "%s"), py_repr(F.col("format"))))
              .when(status == STATUS_NOT_FOUND,
                    F.format_string(DETAIL_NOT_FOUND.replace("{vid}", "%s"), py_repr(vid)))
              .when(status == STATUS_OUT_OF_RANGE,
                    F.format_string(DETAIL_OUT_OF_RANGE.replace("{idx}", "%d").replace("{vid}", "%s")
                                    .replace("{n}", "%d"), idx, py_repr(vid), n)))
    ok = status == STATUS_OK
    return (joined.withColumn("status_code", status).withColumn("detail", detail)
            .withColumn("content_type", F.when(ok, C.content_type(F.col("format"))))
            .withColumn("media_path", F.when(F.col("found"), F.col("media_path")))
            .withColumn("frame_count", F.when(F.col("found"), n)))


def resolve_requests(requests: DataFrame, videos: DataFrame) -> DataFrame:
    """Status per request.

    Output: request_id, video_id, frame_index, format, status_code, detail,
    content_type, media_path, frame_count (the last three for found videos).
    One left join of the requests to the manifest on ``video_id``: one exchange at request
    volume, in which AQE's skew join splits a hot video's requests over several tasks.
    """
    req = requests.select("request_id", "video_id", "frame_index", C.effective_format("format").alias("format"))
    return graded(lookup(req, videos)).select("request_id", *TRIPLE, *RESOLVED)


def status_counts(resolved: DataFrame) -> DataFrame:
    """Requests per status; from ``resolve_distinct`` (sums n_requests) or per-request rows."""
    n = F.sum("n_requests") if "n_requests" in resolved.columns else F.count(F.lit(1))
    return resolved.groupBy("status_code").agg(n.cast("bigint").alias("n_requests"))


def parse_window(window: str = NEIGHBOR_WINDOW) -> list[int]:
    """"1,5" -> [-5, -1, 1, 5]."""
    steps = sorted({abs(int(x)) for x in window.split(",") if x.strip()})
    return sorted([-s for s in steps] + steps)


def neighbors(resolved: DataFrame, window: str = NEIGHBOR_WINDOW) -> DataFrame:
    """Prefetch hints for every servable request; out-of-range hints are dropped.
    A per-row explode of a constant array: no self-join, no shuffle."""
    offs = F.array(*[F.lit(o) for o in parse_window(window)])
    ok = resolved.filter(F.col("status_code") == STATUS_OK)
    hints = ok.select("request_id", "video_id", "frame_index", "format", "frame_count",
                      F.explode(offs).alias("offset"))
    nb = F.col("frame_index") + F.col("offset")
    return hints.filter(C.index_in_range(nb, F.col("frame_count"))).select(
        "request_id", "video_id", "frame_index", "offset", nb.alias("neighbor_index"),
        C.frame_url(F.col("video_id"), nb, F.col("format")).alias("neighbor_url"),
        C.cache_key(F.col("video_id"), nb, F.col("format")).alias("neighbor_key"))


def wanted_frames(resolved: DataFrame) -> DataFrame:
    """Distinct frames to serve (one per cache key) with how many requests want each.
    Accepts ``resolve_distinct`` output (sums n_requests) or per-request rows."""
    ok = resolved.filter(F.col("status_code") == STATUS_OK)
    key = C.cache_key(F.col("video_id"), F.col("frame_index"), F.col("format")).alias("cache_key")
    n = F.sum("n_requests") if "n_requests" in resolved.columns else F.count(F.lit(1))
    # The key determines the other columns; grouping on all of them keeps the plan exact.
    return (ok.groupBy(key, "video_id", "frame_index", "format", "media_path")
            .agg(n.cast("bigint").alias("n_requests")))


def cache_miss_plan(resolved: DataFrame, cached_keys: DataFrame) -> DataFrame:
    """Frames wanted but not yet in the cache. ``cached_keys`` has video_id, frame_index and
    format, the parts of the text key, which the requests are aggregated on as well."""
    return wanted_frames(resolved).join(cached_keys.select(*TRIPLE), TRIPLE, "left_anti")
