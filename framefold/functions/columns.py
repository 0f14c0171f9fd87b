"""Column expressions for every scalar and predicate of the frame index.

All of these are built-in Spark expressions (whole-stage codegen, no Python
in the plan). Names follow the operator they implement.
"""
from __future__ import annotations

import re
from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Operator-marked "do not ingest" directory segment, case-sensitive, bounded by slashes.
SKIP_MARKER = "/skip/"
# Frame formats a request may ask for, and their content types.
ALLOWED_FORMATS = ("png", "jpeg")
DEFAULT_FORMAT = "png"
CONTENT_TYPES = {"png": "image/png", "jpeg": "image/jpeg"}
# Cache-key extension per format (the jpeg extension is our choice: "jpg").
CACHE_EXTENSIONS = {"png": "png", "jpeg": "jpg"}
# Path segments that do not count as parts (like pathlib: empty and ".").
IGNORED_SEGMENTS = ("", ".")
# -----------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 / H3s: literal substring, not a regex. Null path -> null.
def is_skipped(path: str | Column = "media_path") -> Column:
    return _col(path).contains(SKIP_MARKER)


# the sentinel test is ``frame IS NULL``; the status text is never read.
def is_sentinel(frame: str | Column = "frame") -> Column:
    return _col(frame).isNull()


# rows that belong in the manifest (three-valued: null path drops).
def is_ok_frame(frame: str | Column = "frame", path: str | Column = "media_path") -> Column:
    return _col(frame).isNotNull() & ~is_skipped(path)


# non-empty id or link, built only from the columns that exist.
def id_link_nonempty(columns: Iterable[str]) -> Column:
    present = set(columns)
    conds = [F.col(c).isNotNull() & (F.col(c).cast("string") != F.lit(""))
             for c in ("id", "link") if c in present]
    if not conds:
        return F.lit(False)
    return reduce(lambda a, b: a | b, conds)


# H1s: path -> parts, dropping '' and '.' like pathlib (handles '//', trailing '/', '/./').
def path_segments(path: str | Column = "media_path") -> Column:
    # No lambda: array functions with one are not code-generated.
    return reduce(lambda parts, s: F.array_remove(parts, s), IGNORED_SEGMENTS, F.split(_col(path), "/"))


MIN_SEGMENTS = 4  # cruise/camera/timestamp/file


def _segment_from_end(path: str | Column, k: int) -> Column:
    """The k-th segment from the end (k <= MIN_SEGMENTS), null where there are fewer than MIN_SEGMENTS. The path is
    named once: a filter that is pushed down repeats how the path is built for every time it is named."""
    return F.get(F.slice(path_segments(path), -MIN_SEGMENTS, MIN_SEGMENTS), F.lit(MIN_SEGMENTS - k))


def with_cruise_camera(df, path: str = "media_path", strict: bool = False):
    """Add ``cruise`` and ``camera``."""
    cruise, camera = cruise_of(path), camera_of(path)
    if strict:
        cruise, camera = strict_segment(cruise, path), strict_segment(camera, path)
    return df.withColumn("cruise", cruise).withColumn("camera", camera)


def cruise_of(path: str | Column = "media_path") -> Column:
    """4th segment from the end; null when the path has fewer than 4 segments."""
    return _segment_from_end(path, 4)


def camera_of(path: str | Column = "media_path") -> Column:
    """3rd segment from the end; null when the path has fewer than 4 segments."""
    return _segment_from_end(path, 3)


def strict_segment(value: Column, path: str | Column = "media_path") -> Column:
    """Fail the job on a path too short to hold cruise/camera/timestamp/file."""
    return F.coalesce(value, F.when(_col(path).isNotNull(), F.raise_error(F.concat(
        F.lit("media_path is too short to contain cruise/camera/timestamp/file: "), _col(path)))))


# H6s: basename, pathlib-style (a trailing slash does not make it empty).
def basename(path: str | Column = "media_path") -> Column:
    return F.try_element_at(path_segments(path), F.lit(-1))


# A date alone with the line end that ``$`` may stand before; places of the blank in "2020 ", "2020-1 " and "2020-01 ".
LONGEST_DATE = 12
BLANK_AFTER_PART = (5, 7, 8)


# H4s: naive text that means UTC -> TIMESTAMP instant; junk -> null (never throws).
# Text that already names its zone fails the first parse and keeps its own zone.
def parse_utc(text: str | Column) -> Column:
    t = _col(text)
    # Spark accepts no zone after a bare date, so midnight is written out first.
    full = F.when(F.trim(t).rlike(r"^\d{4}(-\d{1,2}){0,2}$"), F.concat(F.trim(t), F.lit(" 00:00:00"))).otherwise(t)
    bare = F.regexp_replace(full, r"^(\d{4}) ", "$1-01-01 ")
    day = F.regexp_replace(bare, r"^(\d{4}-\d{1,2}) ", "$1-01 ")
    # No pattern above can match a longer text whose first blank does not follow a year or a month.
    whole = (F.length(F.trim(t)) > LONGEST_DATE) & ~F.instr(t, " ").isin(*BLANK_AFTER_PART)
    written = F.when(whole, t).otherwise(day)
    return F.coalesce(F.try_to_timestamp(F.concat(written, F.lit("Z"))), F.try_to_timestamp(t))


def utc_wallclock(ts: str | Column) -> Column:
    """TIMESTAMP instant -> TIMESTAMP_NTZ wall clock at UTC, independent of the session zone."""
    return F.convert_timezone(None, F.lit("UTC"), _col(ts).cast("timestamp_ntz"))


# H5s: ISO-8601 with offset, like Python's isoformat(): fraction only when non-zero.
def iso8601_utc(ts: str | Column) -> Column:
    wall = utc_wallclock(ts)
    micros = F.pmod(F.unix_micros(_col(ts)), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.when(_col(ts).isNotNull(), F.concat(
        F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")))


# H7s: strict LONG cast of CSV text: empty -> null, junk -> job failure.
# Integral decimal text ("3.0", "1e3", as float-typed exports write frame numbers)
# is accepted; a fractional or non-numeric value is corrupt and fails the job.
MAX_EXACT_DOUBLE = 2 ** 53
MAX_INT = 2 ** 31 - 1


def whole_number(text: str | Column) -> Column:
    """The number of an integral text, null for empty text and for anything else."""
    t = _col(text)
    as_double = F.trim(t).try_cast("double")
    integral = (as_double.isNotNull() & (as_double == F.floor(as_double))
                & (F.abs(as_double) < F.lit(MAX_EXACT_DOUBLE)))
    return F.coalesce(t.try_cast("bigint"), F.when(integral, as_double.cast("bigint")))


def is_unset(text: str | Column) -> Column:
    t = _col(text)
    return t.isNull() | (F.trim(t) == F.lit(""))


def strict_long(text: str | Column, name: str = "frame") -> Column:
    t = _col(text)
    parsed = whole_number(t)
    return (F.when(is_unset(t), F.lit(None).cast("bigint"))
            .when(parsed.isNull(), F.raise_error(F.concat(
                F.lit(f"invalid integer in column {name}: "), t)))
            .otherwise(parsed))


# H9s
def last_frame_index(frame_count: str | Column = "frame_count") -> Column:
    return _col(frame_count) - F.lit(1)


# F8: request format with the default applied (null = omitted = png).
def effective_format(fmt: str | Column = "format") -> Column:
    return F.coalesce(_col(fmt), F.lit(DEFAULT_FORMAT))


def format_allowed(fmt: str | Column = "format") -> Column:
    return effective_format(fmt).isin(*ALLOWED_FORMATS)


# 0 <= i < frame_count
def index_in_range(index: str | Column = "frame_index",
                   frame_count: str | Column = "frame_count") -> Column:
    return (_col(index) >= 0) & (_col(index) < _col(frame_count))


# H12s
def content_type(fmt: str | Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, ctype in CONTENT_TYPES.items():
        expr = F.when(_col(fmt) == name, F.lit(ctype)).otherwise(expr)
    return expr


# The public URL of a frame (the request contract's path and format parameter).
def frame_url(video_id: str | Column, frame_index: str | Column, fmt: str | Column) -> Column:
    return F.format_string("/frames/%s/%d?format=%s", _col(video_id), _col(frame_index), _col(fmt))


# H11s: {video_id}_{frame_index}.{ext}
def cache_key(video_id: str | Column, frame_index: str | Column, fmt: str | Column) -> Column:
    ext = F.lit(None).cast("string")
    for name, e in CACHE_EXTENSIONS.items():
        ext = F.when(_col(fmt) == name, F.lit(e)).otherwise(ext)
    return F.format_string("%s_%d.%s", _col(video_id), _col(frame_index), ext)


# H10s: fnmatch (case-sensitive, '*' spans '/') -> anchored regex body.
def _lit(c: str) -> str:
    """One character as a literal in both Python and Java regex (inside or outside a class)."""
    return c if c.isalnum() else "\\" + c


def _class_regex(body: str, negate: bool) -> str:
    """An fnmatch character class as a regex that means the same in Python and Java.

    The body is read left to right: ``X-Y`` is a range (kept only when X <= Y;
    a reversed range matches nothing), a hyphen first or last is literal, the
    character after a range is always literal. Every item is escaped on its own,
    so no character is special. No items: never match; negated, any character.
    """
    items: list[str] = []
    k, n = 0, len(body)
    while k < n:
        if k + 2 < n and body[k + 1] == "-":
            lo, hi = body[k], body[k + 2]
            if lo <= hi:
                items.append(_lit(lo) + "-" + _lit(hi))
            k += 3
        else:
            items.append(_lit(body[k]))
            k += 1
    if not items:
        return "." if negate else "(?!)"
    return "[" + ("^" if negate else "") + "".join(items) + "]"


def fnmatch_regex(pattern: str) -> str:
    """Translate a shell pattern into a regex body (no anchors, dot-all needed).

    ``*`` -> ``.*``, ``?`` -> ``.``, ``[!x]`` -> ``[^x]``, an unclosed ``[`` is literal,
    every other character is matched literally.
    """
    out: list[str] = []
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append(re.escape("["))
                continue
            body = pattern[i:j]
            i = j + 1
            negate = body.startswith("!")
            out.append(_class_regex(body[1:] if negate else body, negate))
        else:
            out.append(re.escape(ch))
    return "".join(out)


def excluded_by(path: str | Column, patterns: Iterable[str]) -> Column:
    """True when the full path matches any pattern (patterns OR-ed); False if none."""
    pats = list(patterns)
    if not pats:
        return F.lit(False)
    body = "|".join(f"(?:{fnmatch_regex(p)})" for p in pats)
    return _col(path).rlike(f"(?s)^(?:{body})\\z")


def python_exclude_regex(patterns: Iterable[str]) -> re.Pattern | None:
    """Same translation compiled for Python, for metadata-only checks on listings."""
    pats = list(patterns)
    if not pats:
        return None
    body = "|".join(f"(?:{fnmatch_regex(p)})" for p in pats)
    return re.compile(f"(?s)\\A(?:{body})\\Z")


def file_path_of_metadata() -> Column:
    """``_metadata.file_path`` as a plain path: scheme stripped for local files, URL-decoded. No regex or decoding for
    rows that need none, as this runs for every row of a scan."""
    raw = F.col("_metadata.file_path")
    no_scheme = (F.when(raw.startswith("file://"), F.substring(raw, len("file://") + 1, MAX_INT))
                 .when(raw.startswith("file:"), F.substring(raw, len("file:") + 1, MAX_INT)).otherwise(raw))
    return F.when(raw.contains("%"), F.url_decode(F.replace(no_scheme, F.lit("+"), F.lit("%2B")))).otherwise(no_scheme)
