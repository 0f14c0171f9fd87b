"""Frame coverage: gaps and duplicates from bitmaps, against sets of frame numbers."""
from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

from conftest import clip, export, frame_rows
from framefold.operators import coverage as CV
from framefold.operators import profile as PR
from framefold.operators import quality as QU
from framefold.sources.csv_scan import read_frames_csv


def frames_of(spark, videos: dict[str, list[int]]):
    rows = [(p, f) for p, frames in videos.items() for f in frames]
    return spark.createDataFrame(rows, "media_path string, frame long").repartition(5)


def videos() -> dict[str, list[int]]:
    r = random.Random(5)
    some = {f"/v/{i}": [r.randrange(300) for _ in range(r.randrange(1, 400))] for i in range(25)}
    edges = {"/v/even": list(range(0, 400, 2)), "/v/word": list(range(64, 128)), "/v/late": [70_000], "/v/zero": [0], "/v/blocks": list(range(32_760, 32_776)),
             "/v/full": list(range(200)), "/v/minus": [-70, -1, 0, 2], "/v/below": [-3], "/v/thrice": [0, 1, 1, 1, 2, 2], "/v/top": [63, 127, 191]}
    return some | edges


def test_gaps_and_duplicates_of_every_video(spark):
    given = videos()
    raw = frames_of(spark, given)
    words = CV.frame_words(raw)
    got = {r.media_path: r for r in CV.frame_coverage(words).collect()}
    gaps = collections.defaultdict(list)
    for r in CV.missing_ranges(words).collect():
        gaps[r.media_path] += range(r.first_missing, r.last_missing + 1)
        assert r.n_missing == r.last_missing - r.first_missing + 1
    for path, frames in given.items():
        have = {f for f in frames if f >= 0}
        missing = sorted(set(range(max(frames) + 1)) - have)
        assert sorted(gaps[path]) == missing
        r = got[path]
        assert (r.n_rows, r.n_distinct, r.last_frame, r.n_missing, r.n_duplicate) == (len(frames), len(have), max(frames), len(missing), len(frames) - len(set(frames)))
    assert set(got) == set(given)
    again = sum(n > 1 for frames in given.values() for n in collections.Counter(frames).values())
    assert CV.frames_listed_again(words, raw).first().n == again


def test_neighbouring_runs_are_one_gap_each(spark):
    words = CV.frame_words(frames_of(spark, {"/v/a": [*range(100), *range(300, 100_000), 100_005]}))
    assert [(r.first_missing, r.last_missing) for r in CV.missing_ranges(words).orderBy("first_missing").collect()] == [(100, 299), (100_000, 100_004)]


def test_words_of_two_scans_merge(spark):
    given = videos()
    first, second = ({p: f[i::2] for p, f in given.items() if f[i::2]} for i in (0, 1))
    merged = CV.merge_words(CV.frame_words(frames_of(spark, first)), CV.frame_words(frames_of(spark, second)))
    whole = CV.frame_words(frames_of(spark, given))
    assert sorted(map(tuple, merged.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_a_duplicate_does_not_hide_a_gap(spark, tmp_path):
    rows = frame_rows(clip("K", "bow", "hidden"), [0, 1, 1, 3]) + frame_rows(clip("K", "bow", "sound"), range(4))
    raw = read_frames_csv(spark, [export(tmp_path, "g.csv", rows)])
    profile = PR.media_profile(raw)
    report = {r.check: r.n_items for r in QU.quality_report(raw, profile, PR.videos_from_profile(profile)).collect()}
    assert (report["frame_count_mismatch"], report["duplicate_path_frame"]) == (1, 1)
    (gap,) = CV.missing_ranges(CV.frame_words(raw)).collect()
    assert (gap.media_path, gap.first_missing, gap.last_missing) == (clip("K", "bow", "hidden"), 2, 2)


def test_skipped_and_sentinel_rows_have_no_coverage(spark, tmp_path):
    rows = frame_rows(clip("K", "bow", "x", sub="/skip"), range(3)) + frame_rows(clip("K", "bow", "bad"), [None])
    assert CV.frame_words(read_frames_csv(spark, [export(tmp_path, "s.csv", rows)])).isEmpty()


def test_no_exchange_is_keyed_by_frame(spark):
    raw = spark.range(100_000).selectExpr("'/v/' || (id % 3) AS media_path", "id div 3 AS frame")
    plan = CV.missing_ranges(CV.frame_words(raw))._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any("frame#" in k for k in keys)
    assert "Python" not in plan and plan.index("Exchange") > 0
    words = CV.frame_words(raw.filter(F.col("frame") < 64_000))
    assert words.count() == 3 * -(-33_334 // 64)
