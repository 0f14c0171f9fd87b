from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framefold.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
COLUMNS = ["media_path", "media", "media_time", "frame", "times", "status", "id", "link"]


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8)
    yield s
    s.stop()


def clip(cruise: str, camera: str, stem: str, sub: str = "") -> str:
    """A video path with cruise, camera, day folder and file name."""
    return f"/vault/{cruise}/{camera}{sub}/day-3/{stem}.mkv"


def frame_rows(path: str, frames, media: str | None = None, **over) -> list[dict]:
    """One CSV row per frame number, a tenth of a second apart; ``over`` replaces fields."""
    name = media or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [{"media_path": path, "media": name, "media_time": "2031-08-09 04:05:06.500", "frame": n,
             "times": f"2031-08-09 04:05:{7 + (n or 0) // 10:02d}.{(n or 0) % 10}00", "status": "ok", "id": "", "link": ""} | over for n in frames]


def export(folder, name: str, rows: list[dict], columns=COLUMNS, header: str | None = None) -> str:
    """Write rows as a CSV export with these columns in this order."""
    lines = [",".join(columns) if header is None else header]
    lines += [",".join("" if r.get(c) is None else str(r.get(c, "")) for c in columns) for r in rows]
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)
