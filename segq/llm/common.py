"""Helpers that the operators share: shared storage, cut lineage, batches."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segq.llm import hashing

#: Rows and bytes of an Arrow batch, rows of a batch of the Parquet reader, and
#: bytes of a Parquet row group: a task then holds a few megabytes of whole
#: texts at a time, on both sides, however long single texts are.
ARROW_ROWS, ARROW_BYTES, SCAN_ROWS, GROUP_BYTES = 512, 8 << 20, 512, 8 << 20
#: White space of every contract here: space and U+0009 to U+000D.
WHITE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; where
    that is unset, a folder of the warehouse on one machine (tests), and an
    error on a cluster, whose machines share no local folder."""
    for conf in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if conf:
            return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and
    cuts the lineage.  The schema is kept, so an empty table reads back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._segq_path = path  # noqa: SLF001  for drop()
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    spark, path = df.sparkSession, df._segq_path  # noqa: SLF001
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of jobs that are over."""
    gc.collect()
    spark._jvm.System.gc()


def free(*shared) -> None:
    """Destroy broadcasts that no later plan reads."""
    for b in shared:
        b.destroy()


def slim() -> None:
    """Give memory that this Python worker has freed back to the system; tasks
    call it at their end, as Spark keeps workers for the tasks that follow."""
    hashing.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def tune(spark: SparkSession) -> None:
    """Bound the batches of scans and of Python by rows and bytes, as one text
    may be very long."""
    for name, value in (("execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("parquet.columnarReaderBatchSize", SCAN_ROWS)):
        spark.conf.set(f"spark.sql.{name}", str(value))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(rows: DataFrame, groups: DataFrame, key: str, count: str, top: int = 1024) -> DataFrame:
    """Left join of rows to ``groups``, one row a key with its number of rows.
    Keys of over 1 / ``top`` of all rows, fewer than ``top``, are broadcast and
    their rows never shuffled; no key of the others is above that share."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col(count) * top > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups, key, "left")
    return rows.join(hot, key).unionByName(rest)


def text_of(col: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null id: remainder of '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod
