"""Request resolution (R1), metadata (P3), lookup (J4), neighbours (R5), cache-miss
plan (R4) and path/format scalars."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framefold.functions import columns as C
from framefold.operators import requests as RQ

T0 = dt.datetime(2024, 5, 3, 19, 11, 12, 333000)


@pytest.fixture
def manifest(spark):
    df = spark.createDataFrame(
        [("vid-1", "/data/CRUISE_TEST/Cam0/20240503T191112.333Z/synth.avi", 10, T0, "CRUISE_TEST", "Cam0")],
        "video_id string, media_path string, frame_count bigint, media_time timestamp_ntz, cruise string, camera string")
    return df.withColumn("media_time", F.to_utc_timestamp(F.col("media_time").cast("timestamp"),
                                                          spark.conf.get("spark.sql.session.timeZone")))


def _requests(spark, rows):
    return spark.createDataFrame(rows, "request_id bigint, video_id string, frame_index bigint, format string")


def test_status_codes_in_contract_order(spark, manifest):
    req = _requests(spark, [
        (1, "vid-1", 0, None), (2, "vid-1", 0, "jpeg"), (3, "vid-1", 10, "png"), (4, "vid-1", -1, "png"),
        (5, "no-such-video", 0, "png"), (6, "vid-1", 0, "webp"), (7, "no-such-video", 0, "webp"),
        (8, "vid-1", 9, "png")])
    out = {r.request_id: r for r in RQ.resolve_requests(req, manifest).collect()}
    assert {k: v.status_code for k, v in out.items()} == {1: 200, 2: 200, 3: 416, 4: 416, 5: 404, 6: 400,
                                                         7: 400, 8: 200}
    assert out[1].format == "png" and out[1].content_type == "image/png"
    assert out[2].content_type == "image/jpeg"
    assert out[3].detail == "frame_index=10 out of range for video_id='vid-1' (frame_count=10)"
    assert out[5].detail == "video_id='no-such-video' not in manifest"
    assert "webp" in out[6].detail and out[6].detail == "unknown format: 'webp' (allowed: png, jpeg)"
    assert out[5].media_path is None and out[1].media_path.endswith("synth.avi")


def test_metadata_hides_path(spark, manifest):
    row = RQ.video_metadata(manifest).first()
    assert "media_path" not in row.asDict()
    assert row.frame_count == 10 and row.last_frame_index == 9
    assert row.media_basename == "synth.avi"
    assert row.media_time == "2024-05-03T19:11:12.333000+00:00"
    assert (row.cruise, row.camera) == ("CRUISE_TEST", "Cam0")


def test_iso_without_fraction(spark):
    df = spark.createDataFrame([("2024-05-03 19:11:12.000",)], "t string")
    assert df.select(C.iso8601_utc(C.parse_utc("t"))).first()[0] == "2024-05-03T19:11:12+00:00"


def test_video_lookup_hit_and_miss(spark, manifest):
    ids = spark.createDataFrame([("vid-1",), ("no-such-video",), ("vid-1",)], "video_id string")
    out = {r.video_id: r for r in RQ.video_lookup(ids, manifest).collect()}
    assert out["vid-1"].status_code == 200 and out["vid-1"].frame_count == 10
    assert out["no-such-video"].status_code == 404
    assert "not in manifest" in out["no-such-video"].detail


def test_duplicate_video_id_does_not_fan_out(spark, manifest):
    dup = manifest.unionByName(manifest.withColumn("media_path", F.lit("/z/C/K/t/other.avi")))
    req = _requests(spark, [(1, "vid-1", 0, "png")])
    out = RQ.resolve_requests(req, dup).collect()
    assert len(out) == 1 and out[0].media_path == "/data/CRUISE_TEST/Cam0/20240503T191112.333Z/synth.avi"


def test_neighbors_drop_out_of_range(spark, manifest):
    req = _requests(spark, [(1, "vid-1", 0, "png"), (2, "vid-1", 7, "jpeg"), (3, "vid-1", 99, "png")])
    hints = RQ.neighbors(RQ.resolve_requests(req, manifest))
    got = sorted((r.request_id, r.neighbor_index, r.neighbor_key) for r in hints.collect())
    assert got == [(1, 1, "vid-1_1.png"), (1, 5, "vid-1_5.png"),
                   (2, 2, "vid-1_2.jpg"), (2, 6, "vid-1_6.jpg"), (2, 8, "vid-1_8.jpg")]
    assert RQ.parse_window("1,5") == [-5, -1, 1, 5]


def test_cache_miss_plan(spark, manifest):
    req = _requests(spark, [(1, "vid-1", 0, "png"), (2, "vid-1", 0, "png"), (3, "vid-1", 1, "png"),
                            (4, "vid-1", 1, "jpeg"), (5, "vid-1", 50, "png")])
    cached = spark.createDataFrame([("vid-1", 1, "png")], "video_id string, frame_index bigint, format string")
    plan = {r.cache_key: r.n_requests for r in RQ.cache_miss_plan(RQ.resolve_requests(req, manifest), cached).collect()}
    assert plan == {"vid-1_0.png": 2, "vid-1_1.jpg": 1}


@pytest.mark.parametrize("path,expected", [
    ("/vault/K9/bow/day-3/otter.mkv", ("K9", "bow")),
    ("K9/bow/day-3/otter.mkv", ("K9", "bow")),
    ("//K9//bow/day-3//otter.mkv/", ("K9", "bow")),
    ("/K9/./bow/day-3/otter.mkv", ("K9", "bow")),
    ("/bow/day-3/otter.mkv", (None, None)),
    ("otter.mkv", (None, None)),
])
def test_path_parse(spark, path, expected):
    df = spark.createDataFrame([(path,)], "media_path string")
    r = df.select(C.cruise_of().alias("c"), C.camera_of().alias("k")).first()
    assert (r.c, r.k) == expected


def test_strict_path_parse_raises(spark):
    df = spark.createDataFrame([("bow/otter.mkv",)], "media_path string")
    with pytest.raises(Exception, match="too short"):
        df.select(C.strict_segment(C.cruise_of())).collect()


def test_skip_marker_needs_both_slashes(spark):
    df = spark.createDataFrame([("skip/C/K/t/f.avi",), ("/x/skip/C/K/t/f.avi",), ("/x/Skip/C/K/t/f.avi",),
                                (None,)], "media_path string")
    assert [r[0] for r in df.select(C.is_skipped()).collect()] == [False, True, False, None]


PATHS = [f"/in/{folder}/{stem}.csv" for folder in ("bow", "keel", "bow2") for stem in ("mon", "mon-draft", "tue")]


@pytest.mark.parametrize("patterns,dropped", [
    ([], []),
    (["*-draft.csv"], [p for p in PATHS if "draft" in p]),
    (["/in/keel/tue.csv"], ["/in/keel/tue.csv"]),
    (["*/bow/*", "*/tue.*"], [p for p in PATHS if "/bow/" in p or "tue" in p]),
    (["*.txt", "in/*"], []),
    (["/in/bow[0-9]/*"], [p for p in PATHS if "bow2" in p]),
    (["/in/[!b]*/???.csv"], ["/in/keel/mon.csv", "/in/keel/tue.csv"]),
])
def test_exclude_patterns(spark, patterns, dropped):
    """fnmatch semantics on a DataFrame of paths (order kept) and on a listing."""
    from framefold.sources.csv_scan import apply_excludes
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "i int, p string")
    flagged = df.select("i", "p", C.excluded_by(F.col("p"), patterns).alias("x")).orderBy("i").collect()
    assert [r.p for r in flagged if r.x] == dropped
    kept, dropped_listing = apply_excludes(PATHS, patterns)
    assert dropped_listing == dropped
    assert kept == [p for p in PATHS if p not in dropped]


def test_hot_video_third_of_requests(spark, manifest):
    """One video gets a third of all requests: results stay whole, the manifest
    join sees one row per distinct (index, format), and the per-request join has
    plain shuffles on both sides (eligible for AQE's skew split)."""
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 3600
        rows = [(i, "vid-1", (i // 3) % 12, "png") if i % 3 == 0 else (i, f"other-{i}", 0, "png")
                for i in range(n)]
        req = _requests(spark, rows)
        distinct = RQ.resolve_distinct(req, manifest)
        hot = distinct.filter(F.col("video_id") == "vid-1").collect()
        assert len(hot) == 12 and sum(r.n_requests for r in hot) == n // 3
        out = RQ.resolve_requests(req, manifest)
        assert out.count() == n
        counts = {r.status_code: r.n_requests for r in RQ.status_counts(distinct).collect()}
        assert counts == {200: 1000, 416: 200, 404: 2400}
        assert {r.status_code: r.n_requests for r in RQ.status_counts(out).collect()} == counts
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1
        # one exchange for the requests, and those of the manifest's own aggregate
        assert plan.count("Scan ExistingRDD[request_id") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_utc_does_not_depend_on_the_session_zone(spark, zone):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2030-02-03", "2030-02", "2030", "2030-02-03 00:00:00", "2030-02-03T00:00:00Z", "2030-02-03 05:30:00+05:30", "soon", None]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r[1] for r in sorted(df.select("i", C.iso8601_utc(C.parse_utc("t"))).collect())]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    day = "2030-02-03T00:00:00+00:00"
    assert got == [day, "2030-02-01T00:00:00+00:00", "2030-01-01T00:00:00+00:00", day, day, day, None, None]


def test_neighbor_urls(spark, manifest):
    req = _requests(spark, [(1, "vid-1", 4, None)])
    urls = sorted(r.neighbor_url for r in RQ.neighbors(RQ.resolve_requests(req, manifest)).collect())
    # offsets -5, -1, +1, +5 from index 4: -1 is out of range and dropped
    assert urls == ["/frames/vid-1/3?format=png", "/frames/vid-1/5?format=png", "/frames/vid-1/9?format=png"]


def test_null_index_is_out_of_range(spark, manifest):
    req = _requests(spark, [(1, "vid-1", None, "png"), (2, None, 0, "png")])
    out = {r.request_id: r.status_code for r in RQ.resolve_requests(req, manifest).collect()}
    assert out == {1: 416, 2: 404}
