"""Fixed schemas. No inference anywhere, including partition columns."""
from pyspark.sql import types as T

# Source CSV header, in file order (fixed values).
CSV_COLUMNS = ["media_path", "media", "media_time", "frame", "times", "status", "id", "link"]
OPTIONAL_CSV_COLUMNS = ["id", "link"]

RAW_CSV = T.StructType([T.StructField(c, T.StringType(), True) for c in CSV_COLUMNS])

# Typed per-frame rows as every operator consumes them: ``frame`` is a LONG,
# timestamps stay text until the table projections parse them.
TYPED_FRAMES = T.StructType([
    T.StructField("media_path", T.StringType(), True),
    T.StructField("media", T.StringType(), True),
    T.StructField("media_time", T.StringType(), True),
    T.StructField("frame", T.LongType(), True),
    T.StructField("times", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("link", T.StringType(), True),
])

VIDEOS = T.StructType([
    T.StructField("video_id", T.StringType(), True),
    T.StructField("media_path", T.StringType(), True),
    T.StructField("frame_count", T.LongType(), True),
    T.StructField("media_time", T.TimestampType(), True),
    T.StructField("cruise", T.StringType(), True),
    T.StructField("camera", T.StringType(), True),
])
VIDEO_COLUMNS = [f.name for f in VIDEOS.fields]
VIDEO_PARTITIONS = ["cruise", "camera"]

FRAMES = T.StructType([
    T.StructField("video_id", T.StringType(), True),
    T.StructField("frame_index", T.LongType(), True),
    T.StructField("frame_time", T.TimestampType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("cruise", T.StringType(), True),
])
FRAME_COLUMNS = [f.name for f in FRAMES.fields]
FRAME_PARTITIONS = ["cruise"]

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), True),
    T.StructField("video_id", T.StringType(), True),
    T.StructField("frame_index", T.LongType(), True),
    T.StructField("format", T.StringType(), True),
])

REJECTED = T.StructType([
    T.StructField("source_file", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("record", T.StringType(), True),
    T.StructField("run", T.StringType(), True),
])
REJECTED_PARTITIONS = ["run"]

# State of the media profile: what one file (as listed) holds of one video.
PROFILE_PARTS = T.StructType([
    T.StructField("source_file", T.StringType(), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("modified", T.LongType(), True),
    T.StructField("media_path", T.StringType(), True),
    T.StructField("media", T.StringType(), True),
    T.StructField("media_time", T.StringType(), True),
    T.StructField("n_rows", T.LongType(), True),
    T.StructField("n_frames", T.LongType(), True),
    T.StructField("n_sentinel", T.LongType(), True),
    T.StructField("min_frame", T.LongType(), True),
    T.StructField("max_frame", T.LongType(), True),
    T.StructField("n_id_link", T.LongType(), True),
])
FILE_KEYS = ["source_file", "size", "modified"]
