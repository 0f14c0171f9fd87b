"""Quality report: each fault planted a different number of times, next to sound videos."""
from __future__ import annotations

from conftest import clip, export, frame_rows
from framefold.operators import frames as FR
from framefold.operators import profile as PR
from framefold.operators import quality as QU
from framefold.sources.csv_scan import read_frames_csv


def test_each_check_counts_its_own_faults(spark, tmp_path):
    rows = [r for i in range(8) for r in frame_rows(clip("K", "bow", f"sound{i}"), range(3))]
    rows += [r for i in range(2) for r in frame_rows(clip("K", f"cam{i}", f"twin{i}"), range(1), media="twin")]
    rows += frame_rows(clip("K", "bow", "copied"), [0, 1, 1, 0])
    rows += [r for i in range(3) for r in frame_rows(clip("K", "bow", f"timeless{i}"), range(2), media_time="?")]
    rows += [r for i in range(4) for r in frame_rows(clip("K", "bow", f"gap{i}"), [0, 5])]
    rows += [r for i in range(5) for r in frame_rows(f"loose{i}.mkv", range(1))]
    raw = read_frames_csv(spark, [export(tmp_path, "q.csv", rows)])
    profile = PR.media_profile(raw)
    stored = FR.frames_table(raw).filter("video_id NOT LIKE 'sound%' OR video_id IN ('sound0', 'sound1')")
    report = {r.check: r.n_items for r in QU.quality_report(raw, profile, PR.videos_from_profile(profile), stored).collect()}
    assert report == {"duplicate_video_id": 1, "duplicate_path_frame": 2, "null_media_time": 3,
                      "frame_count_mismatch": 5, "unparseable_path": 5, "video_without_frames": 6}
