"""Connected components of similarity pairs by min-label propagation with
pointer jumping; labels are written between rounds to cut the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.sources.shared import shared_path


def _store(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, "labels")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable over pairs (a, b)."""
    edges = _store(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).union(pairs.select(F.col(b), F.col(a))).distinct())
    labels = _store(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        seen = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("low"))
        hop = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        new = labels.join(seen, "u").join(hop, "label", "left").select("u", F.least("label", "low", "far").alias("label"), (F.least("label", "low", "far") < F.col("label")).alias("moved"))
        new = _store(new)
        labels = new.select("u", "label")
        if not new.filter("moved").limit(1).count():
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
