"""Scalar expressions against the Python semantics they re-express, on many
random inputs in one Spark job each: path parts (pathlib) and ISO-8601 text."""
from __future__ import annotations

import datetime as dt
import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from framefold.functions import columns as C


def _expected_parts(path: str):
    """pathlib parts without the root; fewer than 4 -> (None, None) (documented rule)."""
    pp = PurePosixPath(path)
    parts = list(pp.parts[1:] if pp.anchor else pp.parts)     # the root ('/' or '//') is not a segment
    if len(parts) < 4:
        return None, None
    return parts[-4], parts[-3]


def test_cruise_camera_match_pathlib(spark):
    rnd = random.Random(5)
    alphabet = ["a", "b", "/", "/", ".", "x.avi"]
    paths = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(2000)]
    paths += ["/C/K/t//f", "/C/K/t/f/", "/C/./K/t/f", "C/K/t/f.avi", "./C/K/t/f", "/a/b/c", "////", "."]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, media_path string")
    got = {r.i: (r.cruise, r.camera) for r in C.with_cruise_camera(df).collect()}
    single = {r.i: (r.c, r.k) for r in df.select("i", C.cruise_of().alias("c"), C.camera_of().alias("k")).collect()}
    for i, p in enumerate(paths):
        want = _expected_parts(p)
        assert got[i] == want, (p, got[i], want)
        assert single[i] == want, (p, single[i], want)


def test_basename_matches_pathlib(spark):
    rnd = random.Random(6)
    paths = ["".join(rnd.choice(["a", "/", ".", "b.avi"]) for _ in range(rnd.randint(1, 10))) for _ in range(1000)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, media_path string")
    got = {r.i: r.b for r in df.select("i", C.basename().alias("b")).collect()}
    for i, p in enumerate(paths):
        want = PurePosixPath(p).name or None
        if want is None and p.strip("/") == "":
            continue  # the root itself has no name in either form
        assert got[i] == want, (p, got[i], want)


def test_iso8601_matches_python_isoformat(spark):
    rnd = random.Random(8)
    base = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    stamps = [base + dt.timedelta(microseconds=rnd.randint(0, 4_000_000_000_000_000)) for _ in range(1500)]
    stamps += [base + dt.timedelta(seconds=s) for s in (0, 1, 86399)]   # zero-fraction cases
    texts = [s.strftime("%Y-%m-%d %H:%M:%S.%f") for s in stamps]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.iso for r in df.select("i", C.iso8601_utc(C.parse_utc(F.col("t"))).alias("iso")).collect()}
    for i, s in enumerate(stamps):
        assert got[i] == s.isoformat(), (texts[i], got[i], s.isoformat())


def test_py_repr_matches_python_repr(spark):
    from framefold.operators.requests import py_repr
    rnd = random.Random(9)
    chars = "ab'\"\\ -_./é"
    values = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 8))) for _ in range(1500)]
    values += ["it's", 'say "hi"', "both ' and \"", "back\\slash", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.r for r in df.select("i", py_repr(F.col("v")).alias("r")).collect()}
    for i, v in enumerate(values):
        assert got[i] == repr(v), (v, got[i], repr(v))
