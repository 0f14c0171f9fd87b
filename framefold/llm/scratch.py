"""Sizing and intermediate tables, shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.session import scratch_path


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes sketches, chunks and shards (one JVM-side pass)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def power_of_two(x: float, least: int, most: int) -> int:
    return max(least, min(most, 1 << max(0, int(x) - 1).bit_length()))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_of(chunks: int, *cols: Column) -> Column:
    """A number below ``chunks`` that equal rows share."""
    return F.pmod(F.xxhash64(*cols), F.lit(chunks)).cast("int")
