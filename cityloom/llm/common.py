"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; an own one only where that is unset and Spark runs locally."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by write_table once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        delete_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts; a smaller setting of the session stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        try:
            now = int(str(spark.conf.get(key)).rstrip("b") or 0)
        except ValueError:
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, order: Column, limit: int) -> DataFrame:
    """The limit rows of df with the smallest rank, and all of them if there are no more; the rank is a hash of ``order``.

    Rows that a threshold on the rank can rule out never reach the sort, so that what tasks send on is about the limit, whatever
    the size of df. The threshold leaves limit + 8 roots of it on average; should it ever leave fewer than limit, it is not used.
    """
    rank = F.pmod(F.xxhash64(order, F.lit(41)), F.lit(1 << 40))
    n = df.count()
    few = df
    if n > 2 * limit:
        few = df.where(rank < F.lit(int((1 << 40) * min(1.0, (limit + 8 * limit**0.5 + 8) / n))))
        if few.limit(limit).count() < limit:
            few = df
    return few.orderBy(rank, order).limit(limit)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
