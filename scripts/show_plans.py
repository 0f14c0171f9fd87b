"""Write the final (post-AQE) physical plans of the key jobs to docs/PLANS.md.

    python scripts/show_plans.py [--sf-dir /root/testdata/sf0.01]

Each job runs once (results collected and discarded) so the adaptive plan is
final; the text shows exchanges, join strategies, pushed filters, read schemas
and whole-stage code-generation stages (``*(n)``).
"""
from __future__ import annotations

import argparse
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from framefold.operators import frames as FR  # noqa: E402
from framefold.operators import profile as PR  # noqa: E402
from framefold.operators import quality as QU  # noqa: E402
from framefold.operators import requests as RQ  # noqa: E402
from framefold.session import build_session, scratch_path  # noqa: E402
from framefold.sources import corpus as CO  # noqa: E402
from framefold.sources.csv_scan import read_frames_csv, write_frames_csv  # noqa: E402

NOTES = {
    "videos_from_csv": "One CSV scan; partial + final hash aggregate at frame volume (one exchange "
                       "keyed media_path, media, media_time); the min_by sort aggregate only runs on "
                       "the reduced rows, after the second (video-volume) exchange.",
    "videos_and_counts_from_csv": "Exclusion and id/link counts from the same profile: the value "
                                  "picking (min_by) is pruned, so every aggregate is a hash aggregate.",
    "frames_write_layout": "One rebalance exchange on cruise (AQE splits a hot cruise), then a local sort.",
    "resolve_requests": "Requests collapse to distinct (video, index, format) before the manifest join. "
                        "At this size AQE measures the manifest and the resolved keys as small and "
                        "broadcasts them; on large inputs the same joins stay sort-merge joins with "
                        "plain shuffles on both sides (skew-splittable).",
    "cache_miss_plan": "Distinct wanted keys (partial aggregation) anti-joined with the cached keys; "
                       "broadcast here because AQE measured the cached side as small.",
    "neighbors": "A per-row explode of the offsets: no self-join.",
    "quality_report": "Four branches: duplicate ids, duplicate (path, frame), one pass over the "
                      "profile for three per-video checks, videos without frames.",
}


def final_plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("+- == Initial Plan ==")[0]          # the final plan is what ran
    return re.sub(r"#\d+", "", text).rstrip()


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(ROOT, "docs", "PLANS.md"))
    args = ap.parse_args()
    spark = build_session("local[8]", 8)
    sf = args.sf_dir

    csv_root = scratch_path(spark, "plans-csv")
    write_frames_csv(CO.frames_raw(spark, sf), csv_root)
    csv_raw = read_frames_csv(spark, [f"{csv_root}/*.csv"], headers="canonical")
    raw = CO.frames_raw(spark, sf)
    videos = PR.videos(raw)
    resolved = RQ.resolve_requests(CO.requests(spark, sf), videos)
    jobs = {
        "videos_from_csv": PR.videos(csv_raw),
        "videos_and_counts_from_csv": PR.scan_summary(PR.media_profile(csv_raw)),
        "frames_write_layout": FR.write_layout(FR.frames_table(csv_raw)),
        "resolve_requests": resolved,
        "cache_miss_plan": RQ.cache_miss_plan(RQ.resolve_distinct(CO.requests(spark, sf), videos),
                                              FR.frames_with_keys(raw).select(
                                                  RQ.C.cache_key("video_id", "frame_index",
                                                                 RQ.F.lit("png")).alias("cache_key"))),
        "neighbors": RQ.neighbors(resolved),
        "quality_report": QU.quality_report(raw, PR.media_profile(raw), videos, FR.frames_table(raw)),
    }
    os.makedirs(os.path.dirname(args.out), exist_ok=True)
    with open(args.out, "w") as fh:
        fh.write("# Physical plans of the key jobs\n\n")
        fh.write(f"Generated by `scripts/show_plans.py` on {os.path.basename(sf)}, local[8], AQE on; "
                 "final adaptive plans (expression ids removed).\n\n")
        for name, df in jobs.items():
            fh.write(f"## {name}\n\n{NOTES[name]}\n\n```\n{final_plan(df)}\n```\n\n")
    spark.stop()
    print(args.out)


if __name__ == "__main__":
    main()
