"""Incremental ingest: only new file versions are parsed, and the result is that of a full scan."""
from __future__ import annotations

import os

import pytest

from conftest import COLUMNS, clip, export, frame_rows
from framefold.operators import profile as PR
from framefold.plans import incremental as INC
from framefold.plans.ingest import ingest
from framefold.sources import csv_scan
from framefold.sources.store import ManifestStore

SPLIT = clip("Q7", "bow", "split")  # one video over several files


def same(spark, store, globs, **kw) -> list[str]:
    """Compare with a full scan; returns the names of the files that were read."""
    parts, read = INC.current_parts(spark, store, globs, **kw)
    full = PR.media_profile(csv_scan.read_frames_csv(spark, globs, **kw))
    assert sorted(map(str, PR.merge_parts(parts).select(*full.columns).collect())) == sorted(map(str, full.collect()))
    return [f.rsplit("/", 1)[-1] for f in read]


def test_each_file_version_is_read_once(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "s"))
    globs = [f"{tmp_path}/*.csv"]
    export(tmp_path, "a.csv", frame_rows(SPLIT, range(3, 6)) + frame_rows(clip("Q7", "bow", "bad"), [None]))
    export(tmp_path, "empty.csv", [])
    assert same(spark, store, globs) == ["a.csv", "empty.csv"]
    assert same(spark, store, globs) == []
    export(tmp_path, "b c+%20.csv", frame_rows(SPLIT, range(3), media="earlier", id="ROI") + frame_rows(clip("Z2", "keel", "x", sub="/skip"), [1]))
    assert same(spark, store, globs) == ["b c+%20.csv"]
    assert same(spark, store, globs) == []
    path = export(tmp_path, "a.csv", frame_rows(SPLIT, range(3, 9)), columns=COLUMNS[:6])
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert same(spark, store, globs) == ["a.csv"]
    os.remove(path)
    assert same(spark, store, globs) == []
    assert same(spark, store, [*globs, f"{tmp_path}/b*.csv"]) == [], "a file listed twice counts twice"
    assert same(spark, store, globs, exclude=["*/empty.csv"]) == []


def test_two_scans_at_once_do_not_count_a_file_twice(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "s"))
    export(tmp_path, "a.csv", frame_rows(SPLIT, range(4)))
    INC.current_parts(spark, store, [f"{tmp_path}/*.csv"])
    store.add_profile_parts(store.read_profile_parts())
    assert same(spark, store, [f"{tmp_path}/*.csv"]) == []


def test_a_second_ingest_reads_the_new_file_only(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    globs = [f"{tmp_path}/*.csv"]
    export(tmp_path, "a.csv", frame_rows(SPLIT, range(3)))
    first = ingest(spark, globs, root, frames=True, incremental=True).summary.first()
    assert (first.videos_written, first.frames_written) == (1, 3)
    export(tmp_path, "b.csv", frame_rows(clip("Z2", "keel", "new"), range(5)) + frame_rows(clip("Z2", "keel", "bad"), [None]))
    read, real = [], csv_scan._read_group
    monkeypatch.setattr(csv_scan, "_read_group", lambda spark, sources, *a: read.extend(sources) or real(spark, sources, *a))
    second = ingest(spark, globs, root, frames=True, skip_existing=True, incremental=True).summary.first()
    assert {f.rsplit("/", 1)[-1] for f in read} == {"b.csv"}
    assert (second.partitions_skipped, second.videos_written, second.frames_written, second.bad_file) == (1, 1, 5, 1)
    store = ManifestStore(spark, root)
    assert {(r.video_id, r.frame_count) for r in store.read_videos().collect()} == {("split", 3), ("new", 5)}
    assert store.read_frames().count() == 8
    with pytest.raises(ValueError, match="incremental"):
        ingest(spark, globs, root, incremental=True, dry_run=True)
