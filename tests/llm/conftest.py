from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: One word more often than any other, so that groups and windows share it.
LEXICON = ["the", *[a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "ra", "del", "vo", "x")]]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(LEXICON) if r.random() < 0.3 else f"{r.choice(LEXICON)}{r.randrange(4000)}" for _ in range(n))


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rows() -> list[tuple]:
    """Sound texts, copies, near copies, shared passages, and every edge case that the operators define."""
    base, passage = prose(1, 300), prose(2, 80)
    texts = [base, base, base.replace("the ", "THE ", 1), base + " one more", prose(3, 60) + " " + passage + " " + prose(4, 40),
             passage, prose(5, 200) + "\n" + passage, None, "", " \t\n", "single", "two words", "two  words", "the " * 200, "x" * 5000,
             prose(6, 5000), "é ß İ ΣΑΣ 你好 😀 a", "</s> <|endoftext|>a<|startoftext|>", prose(7, 120), prose(7, 120)]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, base, "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with columns that clash with results and internal names."""
    from pyspark.sql import functions as F

    return (spark.createDataFrame(rows(), SCHEMA).repartition(3)
            .withColumns({c: F.lit("clash") for c in ("n_words", "ids", "kept_text", "copies", "group", "chunk", "key", "row")}))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
