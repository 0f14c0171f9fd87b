"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random bipolar vector of ``DIMENSIONS`` numbers, drawn from its code point
alone. A trigram is bound as ``roll(first, 2) * roll(second, 1) * third``; a text's vector is
the bundle (sum) of its trigrams' vectors, a language's prototype the bundle of its training texts',
and a text gets the language whose prototype has the greatest cosine with it. Texts
are lower-cased; runs of other characters are one word boundary, and every letter gives
the trigram that it is the middle of.

Training sums are whole numbers: each partition adds up one vector per language, and Spark
adds those per language and dimension. What reaches the driver and the workers is
languages times DIMENSIONS numbers, whatever the size of the corpus.

Memory is bounded by the slice (SLICE_BYTES or one text), a block of trigrams and the letters in use.

Defined results: null text or text without letters is ``und`` with score 0; no training text makes
every text ``und``; ties go to the language that is first by name; rows with null language
train nothing; an empty table gives an empty one; columns other than id, text and language are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.scratch import table
from framefold.llm.words import as_bytes, held

DIMENSIONS = 1024
SLICE_BYTES = 1 << 19
SLICE_TEXTS = 1024
CACHED_TRIGRAMS = 1 << 14
TABLE_CELLS = 1 << 22  # texts times trigrams of one dense table of counts
BLOCK_TRIGRAMS = 1 << 12
GATHERED = 1 << 12  # vectors added up at once where a table would be mostly zeros
DENSE = 16  # a table is used when at least one of so many cells is set
FOLDS = 5


class Profiles:
    """Trigram vectors of a worker, by trigram; emptied when they reach CACHED_TRIGRAMS."""

    def __init__(self) -> None:
        self.symbol = np.full(0x110000, -1, np.int32)  # code point -> number; 0 is a boundary
        self.letters = [self.vector(0)]
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((0, DIMENSIONS), np.float32)

    @staticmethod
    def vector(code_point: int) -> np.ndarray:
        return (np.random.default_rng(code_point).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)

    def numbers(self, points: np.ndarray) -> np.ndarray:
        for p in np.unique(points[self.symbol[points] < 0]).tolist():
            if chr(p).isalpha():
                self.symbol[p] = len(self.letters)
                self.letters.append(self.vector(p))
            else:
                self.symbol[p] = 0
        return self.symbol[points]

    def of(self, trigrams: np.ndarray) -> np.ndarray:
        """One row per distinct trigram."""
        listed = trigrams.tolist()
        if len(self.row) + len(listed) > CACHED_TRIGRAMS:
            self.row, self.vectors = {}, np.zeros((0, DIMENSIONS), np.float32)
        new = [t for t in listed if t not in self.row]
        if new:
            t = np.array(new)
            used, place = np.unique(np.stack([t >> 40, (t >> 20) & 0xFFFFF, t & 0xFFFFF]), return_inverse=True)
            letters = np.stack([self.letters[i] for i in used.tolist()])
            a, b, c = place.reshape(3, -1)
            made = np.roll(letters[a], 2, axis=1) * np.roll(letters[b], 1, axis=1) * letters[c]
            self.row.update((x, len(self.vectors) + i) for i, x in enumerate(new))
            self.vectors = np.concatenate([self.vectors, made.astype(np.float32)])
        return self.vectors[[self.row[x] for x in listed]]

    def bundles(self, texts: list[str]) -> np.ndarray:
        """Vectors of the texts; a text without letters has zeros."""
        points = np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le"), np.uint32)
        size = np.array([len(t.lower()) + 1 for t in texts])
        if len(points) != size.sum() + 1:  # a letter's lower case depends on its neighbours in a few scripts
            return np.concatenate([self.bundles([t]) for t in texts]) if len(texts) > 1 else np.zeros((1, DIMENSIONS))
        doc = np.concatenate([np.repeat(np.arange(len(texts)), size), [len(texts) - 1]])
        s = self.numbers(points).astype(np.int64)
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        keep[0] = True
        s, doc = s[keep], doc[keep]
        middle = np.flatnonzero(s[1:-1] > 0) + 1
        key = (s[middle - 1] << 40) | (s[middle] << 20) | s[middle + 1]
        names, back = np.unique(key, return_inverse=True)
        cell, count = np.unique(back * len(texts) + doc[middle], return_counts=True)  # by trigram, then by text
        return self.bundled(names, cell // len(texts), cell % len(texts), count.astype(np.float32), len(texts))

    def bundled(self, names: np.ndarray, column: np.ndarray, doc: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        """Sums of the trigrams' vectors by text, a block of trigrams at a time.

        A block is a product with a table of counts where that is well filled; otherwise (scripts of
        many letters) the vectors are gathered and added up by text, so memory follows neither way
        texts times trigrams.
        """
        out = np.zeros((texts, DIMENSIONS))
        step = max(1, min(BLOCK_TRIGRAMS, TABLE_CELLS // texts))
        for lo in range(0, len(names), step):
            vectors = self.of(names[lo:lo + step])
            i, j = np.searchsorted(column, [lo, lo + len(vectors)])
            if (j - i) * DENSE >= texts * len(vectors):
                counts = np.zeros((texts, len(vectors)), np.float32)
                counts[doc[i:j], column[i:j] - lo] = count[i:j]
                out += counts @ vectors
                continue
            order = i + np.argsort(doc[i:j], kind="stable")
            for k in range(0, len(order), GATHERED):
                at = order[k:k + GATHERED]
                first = np.flatnonzero(np.diff(doc[at], prepend=-1))
                out[doc[at][first]] += np.add.reduceat(vectors[column[at] - lo] * count[at, None], first, axis=0)
        return out


def profiles() -> Profiles:
    return held("profiles", Profiles)


def text_slices(column) -> Iterator[tuple[int, int, list[str]]]:
    a = as_bytes(column)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    lo = 0
    while lo < len(a):
        hi = min(lo + SLICE_TEXTS, max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1))
        yield lo, hi, [b.decode() for b in a[lo:hi].to_pylist()]
        lo = hi


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages by name, one prototype per row) from (lang, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1)):
                made = profiles().bundles(texts)
                langs = np.array(batch.column(0)[lo:hi].to_pylist(), object)
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + made[langs == lang].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([np.rint(v).astype(np.int64) for v in total.values()])], ["lang", "v"])

    sums = (docs.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
            .groupBy("lang", "i").agg(F.sum("x").alias("x")).collect())  # languages * DIMENSIONS rows
    names = sorted({r["lang"] for r in sums})
    out = np.zeros((len(names), DIMENSIONS))
    for r in sums:
        out[names.index(r["lang"]), r["i"]] = r["x"]
    return names, out


def predictions(docs: DataFrame, names: list[str], models: np.ndarray, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of every row of ``docs`` with lang_pred and score."""
    unit = models / np.maximum(np.linalg.norm(models, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(text)):
                made = profiles().bundles(texts)
                norm = np.linalg.norm(made, axis=1)
                cosine = (made @ unit.T) / np.maximum(norm, 1e-300)[:, None]
                best = cosine.argmax(axis=1) if names else np.zeros(hi - lo, int)
                none = (norm == 0) if names else np.ones(hi - lo, bool)
                score = np.zeros(hi - lo) if not names else np.where(none, 0.0, np.clip(cosine[np.arange(hi - lo), best], 0, 1))
                lang = ["und" if n else names[b] for n, b in zip(none, best, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[lo:hi] for k in keys], pa.array(lang, pa.string()), pa.array(score)], [*keys, "lang_pred", "score"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, held_out, lang_pred, score; one fold of five is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS
    docs = docs.withColumn("held_out", fold == 0)
    names, models = prototypes(docs.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"))
    return predictions(docs, names, models, ["doc_id", "held_out"])


QUERIES = {"op6_language": op6_language}
ORACLE: dict[str, str] = {}
