"""Quality rules: base counts and tokeniser fertility with bands per language.

One pass measures every whole text: the base counts, and under a public subword
vocabulary with byte fallback the number of tokens, the byte tokens and the entropy of the
token distribution. A text is encoded word by word (each word with its leading space),
so a worker encodes each distinct word of its slices once.

Verdict. Three measures are compared with the band of the text's group: characters per
token, share of byte tokens, and token entropy over its greatest possible value for that
many tokens. A group is a language (the script where the language is null) and a length
class, the whole binary logarithm of the number of words, as all three depend on length.
The band is the group's median plus and minus ``WIDTH`` times the quartile distance, which
counts as a floor at least; only texts that pass the base rules enter it. Quantiles come
from counts over fixed bins: exact, independent of the partitioning, and as small as
groups times bins; they stay in Spark. A group with fewer than ``LEAST_TEXTS`` such texts takes the
band of the nearest wider one that has them: its language over ``RADII`` length classes to either side,
then its script, then all texts, likewise; failing all, the band of all texts, however few. So every text that
passes the base rules is held against a band, at any size of the table.

Defined results: null or wordless text has zero counts and fails the base rules; ties and
repeated rows are measured alike; an empty table gives an empty one; other columns are
left out, so none can clash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framefold.llm.scratch import stored, table
from framefold.llm.words import Words, held, slices, windows

VOCABULARY = "piece_bpe_32k.model"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
CACHE_WORDS = 150_000
BINS = 2000
LEAST_TEXTS = 50
RADII = (0, 1, 2, 4, 64)  # the last holds every length class
FAMILIES = ("lang", "script", "all")
WIDTH = 5.0
QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
#: measure: (range of the bins, least quartile distance)
MEASURES = {"chars_per_token": ((0.0, 10.0), 0.04), "byte_share": ((0.0, 1.0), 0.02), "entropy_share": ((0.0, 1.0), 0.02)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


class WordPieces:
    """Tokens of distinct words by word hash, at most CACHE_WORDS of them at a time."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.tokens: list[np.ndarray] = []
        self.length: list[np.ndarray] = []

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of the distinct words, end to end; their lengths; distinct word of each word)."""
        names, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.row) > CACHE_WORDS:
            self.clear()
        listed = names.tolist()
        new = [i for i, x in enumerate(listed) if x not in self.row]
        if new:
            coded = self.model.encode([w.text(first[i]).decode() for i in new], num_threads=1)
            have = len(self.row)
            self.row.update((listed[i], have + j) for j, i in enumerate(new))
            self.length.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            self.tokens.append(np.array([t for c in coded for t in c], np.int32))
        self.length, self.tokens = [np.concatenate(self.length)], [np.concatenate(self.tokens)]
        rows = np.fromiter(map(self.row.__getitem__, listed), np.int64, len(listed))
        length, start = self.length[0][rows], (np.cumsum(self.length[0]) - self.length[0])[rows]
        return self.tokens[0][ranges(start, length)], length, back


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    stop = np.cumsum(length)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)


def pieces(path: str) -> WordPieces:
    return held(("pieces", path), lambda: WordPieces(path))


def repeat_words(w: Words) -> np.ndarray:
    """Per text, words in windows of REPEAT_WINDOW words found twice or more in it."""
    n = len(w.counts)
    starts = np.flatnonzero(w.room() >= REPEAT_WINDOW)
    if not len(starts):
        return np.zeros(n, np.int64)
    # The text's number is mixed into the name, so equal windows of two texts differ.
    x = windows(w.hashes(), REPEAT_WINDOW)[starts] ^ (w.doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(x, return_inverse=True, return_counts=True)
    depth = np.zeros(len(w) + 1, np.int32)
    hit = starts[count[back] > 1]
    np.add.at(depth, hit, 1)
    np.add.at(depth, hit + REPEAT_WINDOW, -1)
    return np.bincount(w.doc[np.cumsum(depth[:-1]) > 0], minlength=n)


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def token_entropy(doc: np.ndarray, tokens: np.ndarray, size: int, n: int) -> np.ndarray:
    """Per text, the entropy in bits of its token distribution."""
    key, count = np.unique(doc * size + tokens, return_counts=True)
    of = key // size
    total = np.bincount(of, weights=count, minlength=n)
    inner = np.bincount(of, weights=count * np.log2(count), minlength=n)
    return np.log2(np.maximum(total, 1)) - inner / np.maximum(total, 1)


def measures(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` but text, with counts, entropy and script, for every row."""
    passing = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            for lo, hi, w in slices(batch.column("text")):
                texts = [t or "" for t in batch.column("text")[lo:hi].to_pylist()]
                n = hi - lo
                tokens, length, back = vocabulary.of(w) if len(w) else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
                stop = np.cumsum(length)
                each = tokens[ranges((stop - length)[back], length[back])]
                doc = np.repeat(w.doc, length[back])
                out = {
                    "n_words": w.counts,
                    "word_chars": [len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in texts],
                    "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
                    "n_dup_lines": [dup_lines(t) for t in texts],
                    "n_repeat_words": repeat_words(w),
                    "n_tokens": np.bincount(doc, minlength=n),
                    "n_byte_tokens": np.bincount(doc, weights=vocabulary.is_byte[each], minlength=n),
                }
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[lo:hi] for c in passing], *[pa.array(np.asarray(out[c]).astype(np.int64)) for c in COUNTS],
                     pa.array(token_entropy(doc, each, vocabulary.size, n)), pa.array([script(t) for t in texts], pa.string())],
                    [*passing, *COUNTS, "entropy", "script"])
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in passing] + [f"{c} long" for c in COUNTS]
    return docs.mapInArrow(run, ", ".join([*kinds, "entropy double", "script string"]))


#: First code point of each range and its script class.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x590, "semitic"), (0x900, "indic"),
           (0x1000, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "cjk"), (0xFB00, "other"))


def script(text: str) -> str:
    """Script class of most of the text's code points; ASCII texts are latin."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.searchsorted([a for a, _ in SCRIPTS], points, "right") - 1
    return SCRIPTS[int(np.bincount(at).argmax())][1]


def verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` with base_failed, the three measures and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    safe = F.greatest(F.col("n_tokens"), F.lit(2))
    marked = (measured.withColumn("base_failed", base)
              .withColumn("chars_per_token", F.col("word_chars") / safe)
              .withColumn("byte_share", F.col("n_byte_tokens") / safe)
              .withColumn("entropy_share", F.col("entropy") / F.log2(safe))
              .withColumn("named", F.coalesce("lang", F.concat(F.lit("script "), "script")))
              .withColumn("class", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")))
    limits = stored(unit_bands(marked), "bands")
    kept = ~F.col("base_failed")
    for m in MEASURES:
        # Units whose texts all fail the base rules have no band, and nothing to keep.
        kept = kept & F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(False))
    # One row a unit: Spark broadcasts the stored table if it is small, and splits a hot unit's texts if it is not.
    return marked.join(limits, ["named", "script", "class"], "left").withColumn("kept", kept).select(*marked.columns, "kept")


def binned(marked: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, bin, n): texts that pass the base rules, per bin of each measure."""
    def bin_of(m: str) -> Column:
        (a, b), _ = MEASURES[m]
        return F.struct(F.lit(m).alias("measure"), F.floor((F.col(m) - a) / (b - a) * BINS).cast("int").alias("bin"))

    return (marked.where(~F.col("base_failed")).select(*keys, F.explode(F.array(*map(bin_of, MEASURES))).alias("x"))
            .groupBy(*keys, "x.measure", "x.bin").agg(F.count("*").alias("n")))


def unit_bands(marked: DataFrame) -> DataFrame:
    """(named, script, class, low and high of each measure): the band of every language, script and length class.

    Works on counts per unit and bin, never on texts.
    """
    unit = ["named", "script", "class"]
    counts = stored(binned(marked, *unit), "bins")
    name = {"lang": F.col("named"), "script": F.col("script"), "all": F.lit("")}
    members = F.array(*[F.struct(F.lit(i).alias("family"), name[f].alias("name")) for i, f in enumerate(FAMILIES)])
    # Texts of a family and length class; every text has one bin of each measure.
    sizes = (counts.where(F.col("measure") == next(iter(MEASURES))).select(F.explode(members).alias("f"), "class", "n")
             .groupBy("f.family", "f.name", "class").agg(F.sum("n").alias("n")))
    reach = F.explode(F.array(*[F.lit(r) for r in RADII]))
    centres = counts.select(F.explode(members).alias("f"), F.col("class").alias("centre")).distinct().select("f.family", "f.name", "centre", reach.alias("radius"))
    totals = (centres.join(sizes, ["family", "name"]).where(F.abs(F.col("class") - F.col("centre")) <= F.col("radius"))
              .groupBy("family", "name", "centre", "radius").agg(F.sum("n").alias("total")))
    last = (F.col("family") == len(FAMILIES) - 1) & (F.col("radius") == RADII[-1])
    usable = totals.where((F.col("total") >= LEAST_TEXTS) | last)
    asked = counts.select(*unit).distinct().select(*unit, F.explode(members).alias("f")).select(*unit, "f.family", "f.name", F.col("class").alias("centre"))
    chosen = stored(asked.join(usable, ["family", "name", "centre"]).groupBy(*unit)
                    .agg(F.min(F.struct("family", "radius", "name", F.col("class").alias("centre"))).alias("w")).select(*unit, "w.*"), "chosen")
    wide = chosen.select("family", "name", "centre", "radius").distinct()
    shared = counts.select(F.explode(members).alias("f"), "class", "measure", "bin", "n").groupBy("f.family", "f.name", "class", "measure", "bin").agg(F.sum("n").alias("n"))
    group = F.to_json(F.struct("family", "name", "centre", "radius"))
    pooled = (shared.join(wide, ["family", "name"]).where(F.abs(F.col("class") - F.col("centre")) <= F.col("radius"))
              .withColumn("group", group).groupBy("group", "measure", "bin").agg(F.sum("n").alias("n")))
    limits = limits_of(pooled, least=1)
    return chosen.withColumn("of", group).join(limits, "of").select(*unit, *[c for c in limits.columns if c != "of"])


def bands(marked: DataFrame) -> DataFrame:
    """(of, low and high of each measure) per group of LEAST_TEXTS texts or more, from counts over bins."""
    return limits_of(binned(marked, "group"))


def limits_of(counts: DataFrame, least: int = LEAST_TEXTS) -> DataFrame:
    """The bands of the groups with ``least`` texts or more, from (group, measure, bin, n)."""
    # A window holds the bins of one group and measure, never its texts.
    of = Window.partitionBy("group", "measure")
    counted = counts.withColumn("total", F.sum("n").over(of)).withColumn("seen", F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    quantiles = (counted.where(F.col("total") >= least).groupBy("group", "measure")
                 .agg(*[F.min(F.when(F.col("seen") >= F.ceil(F.col("total") * p), F.col("bin"))).alias(q) for q, p in QUARTILES.items()]))
    sides = []
    for m, ((a, b), floor) in MEASURES.items():
        width = (b - a) / BINS
        half = F.greatest((F.col("q3") - F.col("q1")) * width, F.lit(floor)) * WIDTH
        middle = a + (F.col("q2") + 0.5) * width
        sides += [F.max(F.when(F.col("measure") == m, x)).alias(f"{side}_{m}") for side, x in (("low", middle - half), ("high", middle + half))]
    return quantiles.groupBy(F.col("group").alias("of")).agg(*sides)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """One row of counts, measures and verdicts per row of ``docs``; ``row`` is a hash of id, language and text."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                        F.xxhash64(doc_id, lang, text).alias("row"))
    found = stored(measures(keyed, path or public_tokenizers.path(VOCABULARY)), "fertility")
    return verdicts(found)


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    gone = quality(docs, doc_id, text, lang, path).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(gone, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(doc_id, lang, text) == F.col("__row")), "left_anti")


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, base counts, base_failed, kept and the three measures."""
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept", *MEASURES)


QUERIES = {"op3_fertility": op3_fertility}
ORACLE: dict[str, str] = {}
