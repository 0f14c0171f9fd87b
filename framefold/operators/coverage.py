"""Which frame numbers a video really has: bitmaps of 64 frames, merged per video (Q2, Q5).

One row per (media_path, 64 frames) holds the frames present as bits, so a row stands for up to 64
frames after map-side aggregation, and words of two scans merge by ``|``. (The built-in bitmap
functions take 4 KB per video and no code generation; a video of a few frames needs 8 bytes here.)
From the words come distinct frames, duplicates and the exact missing ranges of each video;
no exchange is keyed by (path, frame), and a video of any length is spread over tasks by word, then by block of
words. Only the ends of runs of frames ever meet per video.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

BLOCK_WORDS = 512       # words of a block: 32,768 frames


def frame_words(raw: DataFrame) -> DataFrame:
    """(media_path, word, bits, odd, n, last) per 64 frame numbers that occur.

    ``bits``: frames present; ``odd``: frames listed an odd number of times; ``n``: rows; ``last``: greatest frame.
    """
    bit = F.expr("shiftleft(1L, CAST(frame & 63 AS INT))")
    return (raw.filter(C.is_ok_frame()).select("media_path", "frame", F.shiftright("frame", 6).alias("word"), bit.alias("bit"))
            .groupBy("media_path", "word")
            .agg(F.bit_or("bit").alias("bits"), F.bit_xor("bit").alias("odd"), F.count(F.lit(1)).alias("n"), F.max("frame").alias("last")))


def _served() -> Column:
    """Words of the frame numbers that can be asked for: 0 and up."""
    return F.col("word") >= 0


def frame_coverage(words: DataFrame) -> DataFrame:
    """Per video: media_path, n_rows, n_distinct, last_frame, n_missing (below its greatest frame), n_duplicate (rows beyond the first)."""
    per = words.groupBy("media_path").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.bit_count("bits")).alias("n_frames"),
        F.coalesce(F.sum(F.when(_served(), F.bit_count("bits"))), F.lit(0)).alias("n_distinct"),
        F.max("last").alias("last_frame"))
    return per.select("media_path", "n_rows", F.col("n_distinct").cast("bigint").alias("n_distinct"), "last_frame",
                      (F.greatest(F.col("last_frame") + 1, F.lit(0)) - F.col("n_distinct")).cast("bigint").alias("n_missing"),
                      (F.col("n_rows") - F.col("n_frames")).cast("bigint").alias("n_duplicate"))


def _runs_of_word() -> Column:
    """[first, last] runs of the frames of one word ``w`` (word, bits)."""
    def runs(w: Column) -> Column:
        def has(i: Column) -> Column:
            return F.getbit(w["bits"], F.least(F.greatest(i, F.lit(0)), F.lit(63))) == 1
        base = w["word"] * 64
        places = F.sequence(F.lit(0), F.lit(63))
        firsts = F.filter(places, lambda i: has(i) & ((i == 0) | ~has(i - 1)))
        lasts = F.filter(places, lambda i: has(i) & ((i == 63) | ~has(i + 1)))
        whole = F.array(F.struct(base.alias("first"), (base + 63).alias("last")))
        return F.when(w["bits"] == -1, whole).otherwise(
            F.zip_with(firsts, lasts, lambda a, b: F.struct((base + a).alias("first"), (base + b).alias("last"))))
    return F.flatten(F.transform("words", runs))


def present_runs(words: DataFrame) -> DataFrame:
    """(media_path, first, last): runs of present frames, cut at block borders at most."""
    blocks = (words.filter(_served()).groupBy("media_path", F.floor(F.col("word") / BLOCK_WORDS).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")))
    runs = blocks.select("media_path", _runs_of_word().alias("runs"))
    firsts = F.filter("runs", lambda r, i: (i == 0) | (F.get("runs", i - 1)["last"] + 1 < r["first"]))
    lasts = F.filter("runs", lambda r, i: (i == F.size("runs") - 1) | (F.get("runs", i + 1)["first"] > r["last"] + 1))
    joined = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last")))
    return runs.select("media_path", F.explode(joined).alias("r")).select("media_path", "r.*")


def missing_ranges(words: DataFrame) -> DataFrame:
    """(media_path, first_missing, last_missing, n_missing): every gap below the greatest frame of a video."""
    before = F.lag("last", 1, -1).over(Window.partitionBy("media_path").orderBy("first"))
    gaps = present_runs(words).withColumn("before", before).filter(F.col("first") > F.col("before") + 1)
    return gaps.select("media_path", (F.col("before") + 1).alias("first_missing"), (F.col("first") - 1).alias("last_missing"),
                       (F.col("first") - F.col("before") - 1).alias("n_missing"))


def merge_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """The words of two disjoint sets of rows, merged: no row is read again."""
    return (a.unionByName(b).groupBy("media_path", "word")
            .agg(F.bit_or("bits").alias("bits"), F.bit_xor("odd").alias("odd"), F.sum("n").alias("n"), F.max("last").alias("last")))


def frames_listed_again(words: DataFrame, raw: DataFrame) -> DataFrame:
    """One row, ``n``: (media_path, frame) pairs with more than one row.

    A frame listed an even number of times is seen from its bits. Where a word has more rows than one per odd
    and two per even frame, some frame is listed three times or more; only the rows of such words are counted one by one.
    """
    even = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("odd")))
    plain = F.col("n") == F.bit_count("bits") + even
    counted = words.filter(plain).select(even.cast("bigint").alias("n"))
    unclear = words.filter(~plain).select("media_path", "word")
    rows = (raw.filter(C.is_ok_frame()).withColumn("word", F.shiftright("frame", 6))
            .join(unclear, ["media_path", "word"], "left_semi").groupBy("media_path", "frame").agg(F.count(F.lit(1)).alias("rows"))
            .select(F.when(F.col("rows") > 1, 1).otherwise(0).cast("bigint").alias("n")))
    return counted.unionByName(rows).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
