"""Exact dedup by digest with a heavy-hitter split; DataFrame functions only.

1. Digests of all texts are written once (id, sha-256).
2. A frequent-items sketch (Spark's ``approx_top_k``: Misra-Gries counters
   with map-side partial sketches) names every digest that holds more than
   1 / ``counters`` of the rows.
3. An exact count verifies the candidates; the winners are at most ``top``
   rows, so they are broadcast and their rows are marked without a shuffle.
4. What is left has no digest above that share: an ordinary shuffle by
   digest deals it evenly.

Defined results: null text is empty text; empty texts equal one another.  Of
equal texts the largest id stays; a null id stays only if the whole group has
null ids.  Rows that repeat both id and text are one document and carry the
same mark.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segq.llm.common import text_of, written

TOP, COUNTERS = 1024, 8192


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_of(text_col), 256).alias("text_sha256")), "digests")
    found = rows.agg(F.expr(f"approx_top_k(text_sha256, {min(top, counters)}, {counters})").alias("t"), F.count("*").alias("n")).first()
    schema = "text_sha256 string"
    candidates = spark.createDataFrame([(x["item"],) for x in found["t"] or [] if x["count"] * counters >= found["n"]], schema)
    verified = (
        rows.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter((F.col("group_size") > 1) & (F.col("group_size") * counters >= found["n"]))
    )
    winners = spark.createDataFrame(verified.limit(top).collect(), "text_sha256 string, keep_id bigint, group_size bigint")
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    by_digest = Window.partitionBy("text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "*", F.max("doc_id").over(by_digest).alias("keep_id"), F.count("*").over(by_digest).alias("group_size")
    )
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
