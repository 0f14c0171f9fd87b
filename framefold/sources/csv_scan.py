"""Per-frame CSV scan: glob expansion (S2), fnmatch excludes (S3), multi-file
scan with header variants (S1, U1) and the typed projection (H7s).

Only file *listings* are handled on the driver (the same listing Spark's own
file index builds); rows never leave the executors.
"""
from __future__ import annotations

import csv
import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schemas import CSV_COLUMNS, OPTIONAL_CSV_COLUMNS, TYPED_FRAMES

log = logging.getLogger("framefold.sources.csv")

# CSV dialect of the exports: RFC 4180 quoting (a quote is escaped by doubling).
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
# Positional binding to the canonical header (no detection pass): rows of older 6-column exports lack the trailing id/link, which come back
# null. Junk in ``frame`` still fails the job (strict cast in ``typed``).
POSITIONAL_CSV_OPTIONS = {**CSV_OPTIONS, "mode": "PERMISSIVE"}


# Records that do not fit are kept whole in a column of their own instead of failing the job.
RECORD = "_record"
# The parser must see all columns, also where a query needs few, or it misses records of the wrong length.
CHECKED_CSV_OPTIONS = {**CSV_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "columnPruning": "false"}
# ---- fixed values (ours): why a row is rejected -----------------------------------
REASON_MALFORMED = "malformed record"
REASON_FRAME = "frame is not a whole number"
REASON_PATH = "path without cruise and camera"
# ---------------------------------------------------------------------------------


class NoInputError(RuntimeError):
    """No CSV file matched the globs, or none was left after excludes."""


class HeaderError(ValueError):
    """A CSV header lacks a required column (only id and link may be absent)."""


REQUIRED_CSV_COLUMNS = [c for c in CSV_COLUMNS if c not in OPTIONAL_CSV_COLUMNS]


def check_header(header: tuple[str, ...], files: list[str] | tuple = ()) -> None:
    missing = [c for c in REQUIRED_CSV_COLUMNS if c not in header]
    if missing:
        raise HeaderError(f"CSV header {','.join(header)!r} lacks required column(s): {', '.join(missing)}"
                          + (f"; file(s): {', '.join(files)}" if files else ""))


def plain_path(path: str) -> str:
    """A listed path without the scheme of local files: the string that patterns are matched against."""
    if path.startswith("file://"):
        return path[len("file://"):]
    return path[len("file:"):] if path.startswith("file:") else path


def expand_globs(spark: SparkSession, patterns: list[str]) -> tuple[list[str], list[str]]:
    """The files of ``glob_listing``, and the patterns that matched."""
    listing, matched = glob_listing(spark, patterns)
    return [path for path, _, _ in listing], matched


def glob_listing(spark: SparkSession, patterns: list[str]) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Expand each pattern with Hadoop's glob; matches sorted per pattern.

    Returns ((path, size, modified ms) of the files, patterns that matched). A pattern without matches is
    reported (Spark itself would raise PATH_NOT_FOUND for it). Duplicates across
    overlapping patterns are kept: such files are scanned twice, as requested.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files: list[tuple[str, int, int]] = []
    matched: list[str] = []
    for pat in patterns:
        hp = jvm.org.apache.hadoop.fs.Path(pat)
        statuses = hp.getFileSystem(conf).globStatus(hp) or []
        # Like a shell glob, '*' and '?' never match hidden names (e.g. '.crc' side files).
        hidden_ok = pat.rstrip("/").rsplit("/", 1)[-1].startswith(".")
        found = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in statuses
                       if s.isFile() and (hidden_ok or not s.getPath().getName().startswith(".")))
        if not found:
            log.warning("glob matched no files: %s", pat)
            continue
        matched.append(pat)
        files.extend(found)
    return files, matched


def apply_excludes(paths: list[str], patterns: list[str]) -> tuple[list[str], list[str]]:
    """S3 on a listing: split into (kept, dropped) by full-path fnmatch; order kept."""
    rx = C.python_exclude_regex(patterns)
    if rx is None:
        return list(paths), []
    kept, dropped = [], []
    for p in paths:
        (dropped if rx.match(plain_path(p)) else kept).append(p)
    return kept, dropped


HEADER_BLOCK = 4096
# Schemes of Hadoop that other readers know by another name (fixed values).
STORE_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _physical(spark: SparkSession, files: list[str]) -> list[str]:
    """Where the files lie, mount points (``viewfs:``) resolved: one look-up a folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, str] = {}
    out = []
    for f in files:
        folder, name = f.rsplit("/", 1)
        if folder not in folders:
            at = jvm.org.apache.hadoop.fs.Path(folder + "/")
            folders[folder] = folder if f.startswith("file:") else at.getFileSystem(conf).resolvePath(at).toString().rstrip("/")
        out.append(f"{folders[folder]}/{name}")
    return out


def _heads(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, value, bytes_read, failed): the first line of every file, read in blocks of HEADER_BLOCK bytes.

    ``failed`` holds why a file cannot be opened through a file-system handle on the executors.
    """
    def heads(batches):
        import pandas as pd
        from pyarrow import fs
        handles: dict[str, fs.FileSystem] = {}

        def opened(uri: str):
            scheme, rest = uri.split(":", 1)
            if scheme == "file":
                return open("/" + rest.lstrip("/"), "rb", buffering=0)
            uri = f"{STORE_SCHEMES.get(scheme, scheme)}:{rest}"
            place = "/".join(uri.split("/", 3)[:3])
            if place not in handles:
                handles[place] = fs.FileSystem.from_uri(uri)[0]
            return handles[place].open_input_file(uri.split("/", 3)[3] if scheme in STORE_SCHEMES else "/" + uri.split("/", 3)[3])

        def first_line(uri: str) -> tuple[str | None, int, str | None]:
            line, n = b"", 0
            try:
                with opened(uri) as f:
                    while block := f.read(HEADER_BLOCK):
                        n += len(block)
                        line += block
                        if b"\n" in block:
                            break
            except (OSError, ValueError, ImportError, NotImplementedError) as e:
                return None, n, f"{type(e).__name__}: {e}"
            return line.split(b"\n", 1)[0].decode("utf-8", "replace").rstrip("\r"), n, None

        for pdf in batches:
            rows = [(f, *first_line(at)) for f, at in zip(pdf["file"], pdf["at"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "value", "bytes_read", "failed"])

    listing = spark.createDataFrame(list(zip(map(plain_path, files), _physical(spark, files), strict=True)), "file string, at string")
    n = max(1, min(len(files), spark.sparkContext.defaultParallelism * 2))
    return listing.repartition(n).mapInPandas(heads, "file string, value string, bytes_read long, failed string")


def _first_records(spark: SparkSession, files: list[str], heads: DataFrame) -> DataFrame:
    """(file, value): the first line of every listed file, from the persisted ``heads``.

    Tasks read a block of each file. Files that the executors cannot open that way (no client library or credentials of
    their own) go through one distributed text scan, which keeps the line with the smallest position of each file.
    """
    failed = {r["file"]: r["failed"] for r in heads.where(F.col("failed").isNotNull()).toLocalIterator()}
    if not failed:
        return heads.select("file", "value")
    log.warning("%d file(s) are read as text to find their headers; first cause: %s", len(failed), next(iter(failed.values())))
    closed = [f for f in files if plain_path(f) in failed]
    lines = spark.read.text(closed).select("value", C.file_path_of_metadata().alias("file"), F.monotonically_increasing_id().alias("at"),
                                           F.col("_metadata.file_block_start").alias("block"))
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("value"))
    listing = spark.createDataFrame([(plain_path(f),) for f in closed], "file string")
    return heads.where(F.col("failed").isNull()).select("file", "value").unionByName(listing.join(first, "file", "left"))


def parse_header(line: str | None) -> tuple[str, ...]:
    """Column names of a header record: RFC 4180 quoting, surrounding blanks and a BOM removed."""
    return tuple(c.strip() for c in next(csv.reader([(line or "").lstrip("\ufeff")]), []))


def file_headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str] | None]:
    """Header -> the plain paths of its files (None: the only header, so all files).

    Decided per file. Every file must bind by name: a file whose first record lacks a
    required column (no header, another layout, an empty file) raises HeaderError naming it,
    and a column name that occurs twice does too. Unknown columns are ignored.
    What reaches the driver is one row per distinct header, and, only where there are several, one
    per listed file, which the driver holds already.
    """
    listed = sorted(set(files))
    heads = _heads(spark, listed).persist()
    try:
        records = _first_records(spark, listed, heads)
        lines = [r["value"] for r in records.select("value").distinct().collect()]
        headers = {line: parse_header(line) for line in lines}
        bad = [line for line, h in headers.items() if not set(REQUIRED_CSV_COLUMNS) <= set(h) or len(set(h)) < len(h)]
        if bad:
            named = [r["file"] for r in records.where(F.coalesce("value", F.lit("")).isin([line or "" for line in bad])).orderBy("file").toLocalIterator()]
            for line in bad:
                check_header(headers[line], named)
            raise HeaderError(f"CSV header names a column twice in: {', '.join(named)}")
        if len(set(headers.values())) == 1:
            return {next(iter(headers.values())): None}
        groups: dict[tuple[str, ...], list[str]] = {}
        for r in records.toLocalIterator():
            groups.setdefault(headers[r["value"]], []).append(r["file"])
        bound = sum(map(len, groups.values()))
        if bound != len(set(files)):
            raise HeaderError(f"{len(set(files))} files listed, {bound} bound to a header")
        return groups
    finally:
        heads.unpersist()


def _read_group(spark: SparkSession, sources: list[str], header: tuple[str, ...],
                options: dict | None = None) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    return spark.read.options(**(options or CSV_OPTIONS)).schema(schema).csv(sources)


def typed(df: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """H7s: strings -> the typed frame schema; absent optional columns become null. ``keep``: columns to pass through."""
    cols = [F.col(c) for c in keep]
    for f in TYPED_FRAMES.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name == "frame":
            cols.append(C.strict_long(F.col("frame")).alias("frame"))
        else:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def checked(df: DataFrame) -> DataFrame:
    """The typed columns, and for a row that cannot be ingested its ``reason`` with ``source_file`` and ``record``."""
    given = [c for c in df.columns if c != RECORD]
    frame = C.whole_number("frame")
    reason = (F.when(F.col(RECORD).isNotNull(), F.lit(REASON_MALFORMED))
              .when(~C.is_unset("frame") & frame.isNull(), F.lit(REASON_FRAME))
              .when(frame.isNotNull() & ~C.is_skipped() & C.cruise_of().isNull(), F.lit(REASON_PATH)))
    record = F.coalesce(F.col(RECORD), F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in given]))
    cols = []
    for f in TYPED_FRAMES.fields:
        value = F.lit(None) if f.name not in given else frame if f.name == "frame" else F.col(f.name)
        cols.append(value.cast(f.dataType).alias(f.name))
    rejected = reason.isNotNull()
    return df.select(*cols, reason.alias("reason"), F.when(rejected, C.file_path_of_metadata()).alias("source_file"),
                     F.when(rejected, record).alias("record"))


def read_frames_checked(spark: SparkSession, patterns: list[str], exclude: list[str] | tuple = ()) -> DataFrame:
    """Like ``read_frames_csv`` with headers detected, but no record ends the job: see ``checked``.

    Rows to ingest have a null ``reason``. A file whose header lacks a required column still raises.
    """
    def group(sources: list[str], header: tuple[str, ...]) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in (*header, RECORD)])
        return checked(spark.read.options(**CHECKED_CSV_OPTIONS).schema(schema).csv(sources))
    return _scan(spark, patterns, exclude, group)


def read_frames_csv(spark: SparkSession, patterns: list[str], exclude: list[str] | tuple = (),
                    headers: str = "detect") -> DataFrame:
    """S1 + S2 + S3 + U1: typed per-frame rows from every matching CSV.

    ``headers="detect"`` binds every file to the names in its own first record (files
    without ``id``/``link`` get nulls, unknown columns are ignored) or raises; no listed file
    is left out. ``headers="canonical"`` skips the detection pass and binds every
    file to the canonical 8-column header by position; missing trailing columns
    (older exports without ``id``/``link``) come back null.
    """
    if headers not in ("detect", "canonical"):
        raise ValueError(f"headers must be 'detect' or 'canonical', not {headers!r}")
    if headers == "canonical":
        kept, whole = _listed(spark, patterns, exclude)
        return typed(_read_group(spark, whole or kept, tuple(CSV_COLUMNS), POSITIONAL_CSV_OPTIONS))
    return _scan(spark, patterns, exclude, lambda sources, header: typed(_read_group(spark, sources, header)))


def _listed(spark: SparkSession, patterns: list[str], exclude: list[str] | tuple) -> tuple[list[str], list[str] | None]:
    """The files to read, and the patterns themselves where nothing of them is excluded."""
    files, matched = expand_globs(spark, list(patterns))
    if not files:
        raise NoInputError("no CSV files matched the supplied glob(s)")
    kept, dropped = apply_excludes(files, list(exclude))
    if dropped:
        log.info("excluding %d file(s) matching exclude patterns", len(dropped))
    if not kept:
        raise NoInputError("no CSV files left after applying excludes")

    # Spark's readers skip names that start with an underscore, even when listed.
    unreadable = [f for f in kept if f.rsplit("/", 1)[-1].startswith("_")]
    if unreadable:
        raise NoInputError(f"file names that start with '_' cannot be read; rename: {', '.join(map(plain_path, unreadable))}")
    return kept, None if dropped else matched


def list_frames_csv(spark: SparkSession, patterns: list[str], exclude: list[str] | tuple = ()) -> list[tuple[str, int, int]]:
    """(path as listed, size, modified ms) of every file that ``read_frames_csv`` would read, as often as it would."""
    kept, _ = _listed(spark, patterns, exclude)
    known = {path: (path, size, modified) for path, size, modified in glob_listing(spark, list(patterns))[0]}
    return [known[path] for path in kept]


def read_frames_of_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Typed rows of listed files, each bound by its own header, with their plain path as ``source_file``."""
    def group(sources: list[str], header: tuple[str, ...]) -> DataFrame:
        rows = _read_group(spark, sources, header).withColumn("source_file", C.file_path_of_metadata())
        return typed(rows, keep=["source_file"])
    return _bound(spark, list(files), None, group)


def _scan(spark: SparkSession, patterns: list[str], exclude: list[str] | tuple,
          read: Callable[[list[str], tuple[str, ...]], DataFrame]) -> DataFrame:
    """Every listed file, bound by its own header, read group by group."""
    return _bound(spark, *_listed(spark, patterns, exclude), read)


def _bound(spark: SparkSession, kept: list[str], whole: list[str] | None,
           read: Callable[[list[str], tuple[str, ...]], DataFrame]) -> DataFrame:
    groups = file_headers(spark, kept)
    if list(groups.values()) == [None]:
        # One header for all files: scan the patterns themselves when nothing is
        # excluded, else the kept listing, so excluded files are never parsed (a
        # file with another layout would fail FAILFAST parsing). Overlapping
        # patterns list a file twice either way, and it is scanned twice.
        (header,) = groups
        return read(whole or kept, header)
    of = {f: h for h, members in groups.items() for f in members}
    sources: dict[tuple[str, ...], list[str]] = {}
    for f in kept:
        sources.setdefault(of[plain_path(f)], []).append(f)
    return reduce(DataFrame.unionByName, [read(paths, header) for header, paths in sources.items()])


def write_frames_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write typed frame rows as per-frame CSV exports (used for fixtures and the bench)."""
    cols = columns or CSV_COLUMNS
    (df.select(*[F.col(c).cast("string") for c in cols])
       .write.mode("errorifexists").options(header="true", quote='"', escape='"').csv(path))
