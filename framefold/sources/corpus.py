"""Derived corpus on the driver's TPC-H-style tables.

The driver's tables hold no per-frame CSVs, so every registered query runs on a
corpus derived from them: a video is an order with its lineitems, a frame is a
lineitem, the cruise is the customer's nation and the camera the order priority.
Planted properties: skip paths, fully unreadable videos, videos with both kinds
of row, natural duplicate (path, frame) rows, empty versus null ``id``.

The output has exactly the typed CSV schema (``schemas.TYPED_FRAMES``), so every
operator runs unchanged on either source.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: the corpus rules ------------------------------------------
MEDIA_ROOT = "/mnt/media/"
SKIP_EVERY = 23          # l_orderkey % 23 = 0  -> video parked under /skip
BAD_EVERY = 31           # l_orderkey % 31 = 0  -> every row is a bad-file sentinel
MIXED_EVERY = 37         # l_orderkey % 37 = 0  -> line 1 is a sentinel, other lines are frames
FRAME_MS_STEP = 66       # frame time = order date + l_linenumber * 66 ms
ID_EVERY = 97            # l_partkey % 97 = 0 -> id 'ROI-<partkey>'; else even partkey -> ''
LINK_EVERY = 89          # l_partkey % 89 = 0 -> link
LINK_VALUE = "https://example/x"
HOT_EVERY = 4            # event_id % 4 = 0 -> the request asks for HOT_VIDEO
HOT_VIDEO = "vid-7"
# Faults planted for the quality report only.
SAME_ID_EVERY = 41       # okey % 41 = 0 -> the id of the video okey + 1
NO_TIME_EVERY = 43       # okey % 43 = 0 -> an unreadable media time
SHORT_PATH_EVERY = 59    # okey % 59 = 0 -> a path without cruise and camera
UNSTORED_EVERY = 61      # okey % 61 = 0 -> no frames in the store
JUNK_FRAME_EVERY = 53    # okey % 53 = 0 -> a frame number that is none (exports with faults only)
CUT_RECORD_EVERY = 67    # okey % 67 = 0 -> a record of three fields
LONG_RECORD_EVERY = 73   # okey % 73 = 0 -> a record with a field too many
FILE_ORDERS = 4096       # orders per export with faults
REEL_STEP = 8            # frame numbers of a reel between orders
# Seeded "already stored" partitions for the store queries.
SEEDED_CAMERAS = ("Cam1", "Cam2")
SEEDED_CRUISE_BELOW = "CRUISE_10"
# ------------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frames_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed per-frame rows of the derived corpus, one per lineitem."""
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")

    # orders x customer first: the smaller join runs before the lineitem-volume one.
    # customer is broadcast only when Spark's size estimate allows it. What a video's frames share is
    # worked out here, once per order; filters on paths are pushed down to here as well.
    okey = F.col("o_orderkey")
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    cruise = F.concat(F.lit("CRUISE_"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    camera = F.concat(F.lit("Cam"), F.substring("o_orderpriority", 1, 1))
    media = F.concat(F.lit("vid-"), okey.cast("string"))
    stamp = F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lit("T000000.000Z"))
    skip_dir = F.when((okey % SKIP_EVERY) == 0, F.lit("/skip")).otherwise(F.lit(""))
    order_side = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", day.alias("day"), media.alias("media"),
        F.concat(F.lit(MEDIA_ROOT), cruise, F.lit("/"), camera, skip_dir, F.lit("/"), stamp,
                 F.lit("/"), media, F.lit(".avi")).alias("media_path"))
    # lineitem is the frame-volume side: never a broadcast build side. A shuffle
    # (sort-merge) join is what runs at scale anyway, and it spreads the per-row
    # work that follows (parsing, partial aggregation) over all partitions.
    x = lineitem.join(order_side.hint("merge"), lineitem.l_orderkey == order_side.o_orderkey)

    lnum, pkey = F.col("l_linenumber"), F.col("l_partkey")
    bad: Column = ((okey % BAD_EVERY) == 0) | (((okey % MIXED_EVERY) == 0) & (lnum == 1))

    return x.select(
        "media_path",
        "media",
        F.concat("day", F.lit(" 00:00:00.000")).alias("media_time"),
        F.when(bad, F.lit(None)).otherwise((lnum - 1).cast("bigint")).alias("frame"),
        F.when(bad, F.lit(None)).otherwise(F.concat(
            F.col("day"), F.lit(" 00:00:00."), F.lpad((lnum * FRAME_MS_STEP).cast("string"), 3, "0"))).alias("times"),
        F.when(bad, F.lit("bad_file")).otherwise(F.lit("ok")).alias("status"),
        F.when((pkey % ID_EVERY) == 0, F.concat(F.lit("ROI-"), pkey.cast("string")))
         .when((pkey % 2) == 0, F.lit("")).alias("id"),
        F.when((pkey % LINK_EVERY) == 0, F.lit(LINK_VALUE)).alias("link"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of frame requests derived from ``events``: one request per event.

    The video asked for follows the event over the orders' key pattern (8 keys in every 32),
    so distinct ids grow with the table; every HOT_EVERY-th request asks for one hot video.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("request_id"),
        F.when((eid % 11) == 0, F.concat(F.lit("missing-"), eid.cast("string")))
         .when((eid % HOT_EVERY) == 0, F.lit(HOT_VIDEO))
         .otherwise(F.concat(F.lit("vid-"), (F.floor(eid / 8) * 32 + eid % 8).cast("string"))).alias("video_id"),
        ((eid % 9).cast("bigint") - 1).alias("frame_index"),
        F.when(F.col("event_type") == "error", F.lit("webp"))
         .when(F.col("event_type") == "view", F.lit("jpeg"))
         .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
         .otherwise(F.lit("png")).alias("format"),
    )


def order_key() -> Column:
    """The order behind a row of the corpus."""
    return F.substring("media", 5, 20).cast("bigint")


def faulty(raw: DataFrame) -> DataFrame:
    """The corpus with faults for the quality report: shared ids, unreadable times, short paths."""
    okey = order_key()
    return raw.withColumns({
        "media_path": F.when(okey % SHORT_PATH_EVERY == 0, F.concat(F.lit("loose/"), "media", F.lit(".avi"))).otherwise(F.col("media_path")),
        "media_time": F.when(okey % NO_TIME_EVERY == 0, F.lit("unknown")).otherwise(F.col("media_time")),
        "media": F.when(okey % SAME_ID_EVERY == 0, F.concat(F.lit("vid-"), (okey + 1).cast("string"))).otherwise(F.col("media")),
    })


def faulty_exports(raw: DataFrame, columns: list[str]) -> DataFrame:
    """(file, value), the text of one CSV file per row: the corpus with unreadable frame numbers and records of the wrong length."""
    okey = order_key()
    frame = F.when((okey % JUNK_FRAME_EVERY == 0) & F.col("frame").isNotNull(), F.concat(F.lit("n/a "), F.col("frame").cast("string"))).otherwise(F.col("frame").cast("string"))
    fields = [F.coalesce(frame if c == "frame" else F.col(c), F.lit("")) for c in columns]
    line = (F.when(okey % CUT_RECORD_EVERY == 0, F.concat_ws(",", *fields[:3]))
            .when(okey % LONG_RECORD_EVERY == 0, F.concat_ws(",", *fields, F.lit("more"))).otherwise(F.concat_ws(",", *fields)))
    return (raw.select(F.floor(okey / FILE_ORDERS).alias("file"), line.alias("line"))
            .groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
            .select("file", F.concat(F.lit(",".join(columns) + "\n"), "lines").alias("value")))


def reels(raw: DataFrame) -> DataFrame:
    """The corpus with one long video per cruise and camera: frame numbers are order * REEL_STEP + line, with many gaps."""
    folder = F.array_join(F.slice(F.split("media_path", "/"), 1, 5), "/")
    return raw.withColumns({"media_path": F.concat(folder, F.lit("/reels/reel.avi")), "frame": order_key() * REEL_STEP + F.col("frame")})


def seeded_partition(cruise: str | Column = "cruise", camera: str | Column = "camera") -> Column:
    """Predicate for the partitions the store queries pre-seed as already stored."""
    c = F.col(cruise) if isinstance(cruise, str) else cruise
    k = F.col(camera) if isinstance(camera, str) else camera
    return k.isin(*SEEDED_CAMERAS) & (c < F.lit(SEEDED_CRUISE_BELOW))


# ---- the same corpus as DuckDB SQL, for the oracle ---------------------------
FRAMES_RAW_SQL = """
SELECT concat('/mnt/media/', cruise, '/', camera, CASE WHEN okey % 23 = 0 THEN '/skip' ELSE '' END,
              '/', stamp, '/', media, '.avi') AS media_path,
       media, concat(d, ' 00:00:00.000') AS media_time,
       CASE WHEN bad THEN NULL ELSE CAST(lnum - 1 AS BIGINT) END AS frame,
       CASE WHEN bad THEN NULL ELSE concat(d, ' 00:00:00.', lpad(CAST(lnum * 66 AS VARCHAR), 3, '0')) END AS times,
       CASE WHEN bad THEN 'bad_file' ELSE 'ok' END AS status,
       CASE WHEN pkey % 97 = 0 THEN concat('ROI-', CAST(pkey AS VARCHAR)) WHEN pkey % 2 = 0 THEN '' END AS id,
       CASE WHEN pkey % 89 = 0 THEN 'https://example/x' END AS link
FROM (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_partkey AS pkey,
             concat('CRUISE_', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS cruise,
             concat('Cam', substr(o_orderpriority, 1, 1)) AS camera,
             concat('vid-', CAST(l_orderkey AS VARCHAR)) AS media,
             substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS d,
             concat(replace(substr(CAST(o_orderdate AS VARCHAR), 1, 10), '-', ''), 'T000000.000Z') AS stamp,
             (l_orderkey % 31 = 0 OR (l_orderkey % 37 = 0 AND l_linenumber = 1)) AS bad
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) x
"""

REQUESTS_SQL = """
SELECT event_id AS request_id,
       CASE WHEN event_id % 11 = 0 THEN concat('missing-', CAST(event_id AS VARCHAR))
            WHEN event_id % 4 = 0 THEN 'vid-7'
            ELSE concat('vid-', CAST((event_id // 8) * 32 + event_id % 8 AS VARCHAR)) END AS video_id,
       CAST(event_id % 9 AS BIGINT) - 1 AS frame_index,
       CASE event_type WHEN 'error' THEN 'webp' WHEN 'view' THEN 'jpeg' WHEN 'signup' THEN NULL ELSE 'png' END AS format
FROM events
"""

FAULTY_SQL = """
SELECT CASE WHEN okey % 59 = 0 THEN concat('loose/', media, '.avi') ELSE media_path END AS media_path,
       CASE WHEN okey % 41 = 0 THEN concat('vid-', CAST(okey + 1 AS VARCHAR)) ELSE media END AS media,
       CASE WHEN okey % 43 = 0 THEN 'unknown' ELSE media_time END AS media_time, frame, times, status, id, link, okey
FROM (SELECT *, CAST(substr(media, 5) AS BIGINT) AS okey FROM clean_raw) y
"""

REELS_SQL = """
SELECT array_to_string(string_split(media_path, '/')[1:5], '/') || '/reels/reel.avi' AS media_path,
       CAST(substr(media, 5) AS BIGINT) * 8 + frame AS frame
FROM frames_raw
"""

SEEDED_SQL = "camera IN ('Cam1', 'Cam2') AND cruise < 'CRUISE_10'"
