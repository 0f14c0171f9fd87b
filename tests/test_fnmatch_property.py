"""The exclude-pattern translation agrees with fnmatch.fnmatchcase (the reference's
matcher), on the driver (Python regex) and on the executors (Java regex via rlike)."""
from __future__ import annotations

import fnmatch

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framefold.functions import columns as C

ALPHABET = "ab/._-*?[]!^&~\\"
patterns = st.text(alphabet=ALPHABET, min_size=0, max_size=8)
paths = st.text(alphabet="ab/._-[]!^&~\\", min_size=0, max_size=10)


@settings(max_examples=3000, deadline=None)
@given(patterns, paths)
def test_python_side_matches_fnmatch(pattern, path):
    rx = C.python_exclude_regex([pattern])
    assert bool(rx.match(path)) == fnmatch.fnmatchcase(path, pattern)


TRICKY = ["é*", "*€", "[é-ü]*", "[[-?]", "[a--b]", "[!]-a]", "[a-]", "[-a]", "[!]", "[]", "[z-a]x", "*-draft.csv", "*/bow[!1]/*", "a[&&b]*", "[[]x", "[]a]*", "[!]]b", "x[a-c]?", "[^a]*", "*\\*",
          "a[~]b", "[", "a[b", "*[!/]", "**/x", "?"]
SAMPLE_PATHS = ["éa", "a€", "ö", "/d/bow2/f.csv", "/d/bow1/f.csv", "x-draft.csv", "a&b", "ab", "[x", "]a", "b", "]b",
                "xb?", "xaz", "^a", "a", "q*", "a~b", "[", "a[b", "/x", "x/", "a/b/x", ""]


def test_spark_side_matches_fnmatch(spark):
    df = spark.createDataFrame([(p,) for p in SAMPLE_PATHS], "p string")
    for pat in TRICKY:
        got = {r.p for r in df.filter(C.excluded_by(F.col("p"), [pat])).collect()}
        want = {p for p in SAMPLE_PATHS if fnmatch.fnmatchcase(p, pat)}
        assert got == want, pat


def test_spark_side_random_patterns(spark):
    """100 random patterns x 60 random paths in one job, each against fnmatch."""
    import random
    rnd = random.Random(11)
    pat_chars, path_chars = "ab/._-*?[]!^&~\\|()+{}$é", "ab/._-[]!^&~\\|()+{}$é"
    pats = ["".join(rnd.choice(pat_chars) for _ in range(rnd.randint(0, 9))) for _ in range(100)]
    paths = ["".join(rnd.choice(path_chars) for _ in range(rnd.randint(0, 10))) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select("p", *[C.excluded_by(F.col("p"), [q]).alias(f"c{i}") for i, q in enumerate(pats)]).collect()
    for r in rows:
        for i, q in enumerate(pats):
            assert bool(r[f"c{i}"]) == fnmatch.fnmatchcase(r.p, q), (q, r.p)
