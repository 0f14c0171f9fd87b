"""Rows that cannot be ingested are set aside with file and reason; good rows of the same files go in."""
from __future__ import annotations

import collections

import pytest

from conftest import COLUMNS, clip, export, frame_rows
from framefold.plans.ingest import RejectShareError, ingest
from framefold.sources.csv_scan import REASON_FRAME, REASON_MALFORMED, REASON_PATH, read_frames_checked, read_frames_csv
from framefold.sources.store import ManifestStore

GOOD = clip("Q7", "bow", "a")


def line(row: dict) -> str:
    return ",".join("" if row.get(c) is None else str(row[c]) for c in COLUMNS)


def faulty(folder, name="bad.csv") -> tuple[str, collections.Counter]:
    rows = frame_rows(GOOD, range(40))
    lines = [line(r) for r in rows]
    lines[3] = "only,three,fields"
    lines[5] += ",one,too many"
    lines[8] = line(rows[8] | {"frame": "8.5"})
    lines[9] = line(rows[9] | {"frame": "x"})
    lines[10] = line(rows[10] | {"frame": "10.0"})           # a whole number
    lines[11] = line(rows[11] | {"frame": ""})               # a sentinel
    lines[12] = line(rows[12] | {"media_path": "short.mkv"})
    lines[13] = line(rows[13] | {"times": "yesterday"})      # an unreadable time is null, not a fault
    lines[14] = line(rows[14] | {"media_path": "short.mkv", "frame": ""})
    path = folder / name
    path.write_text(",".join(COLUMNS) + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path), collections.Counter({REASON_MALFORMED: 2, REASON_FRAME: 2, REASON_PATH: 1})


def test_bad_rows_land_in_rejected_and_good_ones_are_stored(spark, tmp_path):
    path, want = faulty(tmp_path)
    sound = export(tmp_path, "sound.csv", frame_rows(clip("Z2", "keel", "b"), range(5)), columns=COLUMNS[:6])
    root = str(tmp_path / "s")
    report = ingest(spark, [path, sound], root, frames=True, max_reject_share=0.2)
    store = ManifestStore(spark, root)
    rows = store.read_rejected().collect()
    assert collections.Counter(r.reason for r in rows) == want
    assert {r.source_file.rsplit("/", 1)[-1] for r in rows} == {"bad.csv"} and len({r.run for r in rows}) == 1
    assert {"only,three,fields"} < {r.record for r in rows}
    assert collections.Counter({r.reason: r.n_rows for r in report.rejected.collect()}) == want
    assert {r.video_id: r.frame_count for r in store.read_videos().collect()} == {"a": 33, "b": 5}
    kept = {r.frame_index for r in store.read_frames().filter("video_id = 'a'").collect()}
    assert kept == set(range(40)) - {3, 5, 8, 9, 11, 12, 14}
    assert report.summary.first().frames_written == 38


def test_too_large_a_share_fails_and_writes_nothing(spark, tmp_path):
    path, want = faulty(tmp_path)
    with pytest.raises(RejectShareError, match="5 of 40") as err:
        ingest(spark, [path], str(tmp_path / "s"), frames=True, max_reject_share=0.12)
    assert sum(r.n_rows for r in err.value.rejected.collect()) == 5
    assert ManifestStore(spark, str(tmp_path / "s")).read_videos().isEmpty()
    assert ingest(spark, [path], str(tmp_path / "s"), max_reject_share=0.125).summary.first().status == "written"


def test_without_a_share_the_first_bad_record_still_ends_the_run(spark, tmp_path):
    path, _ = faulty(tmp_path)
    with pytest.raises(Exception, match="(?i)malformed|invalid integer|too short"):
        ingest(spark, [path], str(tmp_path / "s"))
    with pytest.raises(ValueError, match="detected"):
        ingest(spark, [path], str(tmp_path / "s"), headers="canonical", max_reject_share=0.5)


def test_sound_files_read_the_same_either_way(spark, tmp_path):
    sound = export(tmp_path, "sound.csv", frame_rows(GOOD, [0, 1, None, 3]) + frame_rows(clip("Q7", "bow", "p", sub="/skip"), range(2)))
    plain = read_frames_csv(spark, [sound])
    both = read_frames_checked(spark, [sound])
    assert both.filter("reason IS NOT NULL OR record IS NOT NULL").isEmpty()
    assert sorted(map(str, both.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    report = ingest(spark, [sound], str(tmp_path / "s"), max_reject_share=0.0)
    assert report.rejected is None and "rejected" not in report.seconds
    assert ManifestStore(spark, str(tmp_path / "s")).read_rejected().isEmpty()


def test_a_dry_run_counts_but_writes_nothing(spark, tmp_path):
    path, want = faulty(tmp_path)
    report = ingest(spark, [path], str(tmp_path / "s"), dry_run=True, max_reject_share=1.0)
    assert sum(r.n_rows for r in report.rejected.collect()) == sum(want.values())
    assert not (tmp_path / "s").exists() or ManifestStore(spark, str(tmp_path / "s")).read_rejected().isEmpty()


def test_rejected_rows_are_scanned_for_once(spark, tmp_path, monkeypatch):
    """Counts and stored rows come from one scan for rejects: the stored rows are not parsed again."""
    path, want = faulty(tmp_path)
    plans, write = {}, ManifestStore.write

    def noted(self, table, rows, *rest):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()
        return write(self, table, rows, *rest)
    monkeypatch.setattr(ManifestStore, "write", noted)
    ingest(spark, [path], str(tmp_path / "s"), frames=True, max_reject_share=0.5)
    assert "csv" in plans["frames"] and "csv" not in plans["rejected"]
    assert collections.Counter(r.reason for r in ManifestStore(spark, str(tmp_path / "s")).read_rejected().collect()) == want
