"""Incremental runs: a resumable batch read as a stream with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segq.plans.dialect import DUCK, SPARK
from segq.sources.shared import shared_path


def alert_windows(events: DataFrame) -> DataFrame:
    """Alerts per type in ten-minute windows; late rows up to an hour count."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def resumable(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform) -> None:
    """Process what is new in a folder, once; a rerun resumes where it ended."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def import_once(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, per_run: int | None = None) -> DataFrame:
    """Import what is new in a folder: cleaned, blanks dropped, one row per
    content hash over all runs.  A batch is written under its number, so one
    that is repeated after a failure replaces itself; rows of earlier batches
    are the state, read from the sink, so none is kept in memory."""
    hashed = SPARK.sha(SPARK.norm("text"))
    rows = f"{sink}/batch=*"

    def put(batch: DataFrame, number: int) -> None:
        new = batch.selectExpr("doc_id", "trim(coalesce(text, '')) AS source_text", f"{hashed} AS source_hash").filter("length(source_text) > 0")
        new = new.groupBy("source_hash").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.length("source_text"), "doc_id").alias("n"), F.lit("new").alias("status"))
        before = [f"{sink}/batch={k}" for k in committed(spark, sink) if k < number]
        if before:
            new = new.join(spark.read.schema(IMPORTED).parquet(*before).select("source_hash"), "source_hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema)
    if per_run:
        stream = stream.option("maxFilesPerTrigger", per_run)
    stream.parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(IMPORTED).parquet(rows)


IMPORTED = "source_hash string, doc_id long, n int, status string"


def committed(spark: SparkSession, sink: str) -> list[int]:
    """Numbers of the batches in the sink."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)  # noqa: SLF001
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")) if fs.exists(path) else []


def stream_segment_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments imported incrementally, each text once."""
    base = shared_path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return import_once(spark, f"{sf_dir}/documents*.parquet", schema, f"{base}/sink", f"{base}/checkpoint")


def stream_alert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of alerts that the watermark has closed."""
    base = shared_path(spark, "alerts")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    flat = lambda df: alert_windows(df).select(F.col("window.start").cast("string").alias("starts"), "event_type", "n", F.round("total", 2).alias("total"))
    resumable(spark, f"{sf_dir}/events*.parquet", schema, f"{base}/sink", f"{base}/checkpoint", flat)
    return spark.read.schema("starts string, event_type string, n long, total double").parquet(f"{base}/sink")


def queries():
    return {"stream_segment_import": stream_segment_import, "stream_alert_windows": stream_alert_windows}


def oracle_sql():
    h = DUCK.sha(DUCK.norm("text"))
    return {
        "stream_segment_import": f"SELECT {h} AS source_hash, min(doc_id) AS doc_id, CAST(min_by(length(trim(text)), doc_id) AS INT) AS n, 'new' AS status FROM documents WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY {h}",
        "stream_alert_windows": """SELECT CAST(starts AS VARCHAR) AS starts, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT time_bucket(INTERVAL '10 minutes', CAST(ts AS TIMESTAMP), TIMESTAMP '2000-01-01') AS starts, * FROM events) e
WHERE starts + INTERVAL '10 minutes' <= (SELECT CAST(max(ts) AS TIMESTAMP) FROM events) - INTERVAL '1 hour' GROUP BY starts, event_type""",
    }
