"""Round trips through the file formats, and similarity that SQL lacks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segq.functions.similarity import ratcliff
from segq.operators.graph import components
from segq.plans.core import render, run, spark_queries, table, tables_of
from segq.plans.dialect import DUCK
from segq.sources import files
from segq.sources.shared import shared_path
from segq.sources.versions import Versions


def dup_components(spark, sf_dir):
    return components(spark_queries()["dup_fuzzy_pairs"](spark, sf_dir), "a_id", "b_id")


def dup_ratcliff_pairs(spark, sf_dir):
    pairs = spark_queries()["dup_fuzzy_pairs"](spark, sf_dir)
    texts = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.lower(F.trim("p_name")).alias("t")).agg(F.min("p_partkey").alias("id"))
    a, b = texts.select(F.col("id").alias("a_id"), F.col("t").alias("ta")), texts.select(F.col("id").alias("b_id"), F.col("t").alias("tb"))
    return pairs.join(a, "a_id").join(b, "b_id").select("a_id", "b_id", ratcliff(F.col("ta"), F.col("tb")).alias("percent"))


def tsv_round_trip(spark, sf_dir):
    path = shared_path(spark, "tsv")
    files.write_tsv(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", "p_brand").distinct(), path, "p_name")
    return files.read_tsv(spark, path, ["p_name", "p_brand"])


def tmx_round_trip(spark, sf_dir):
    path = shared_path(spark, "tmx")
    files.write_tmx(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", "p_type").distinct(), path, "p_name", "p_type")
    return files.read_tmx(spark, path)


def json_round_trip(spark, sf_dir):
    path = shared_path(spark, "json")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.json(path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


def versioned_merge(spark, sf_dir):
    """Segments as a table in versions: created, widened twice, merged twice
    (a patch of prices for half of them, and new rows); repeats change nothing."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    table = Versions(spark, shared_path(spark, "segments"), "id")
    rows = part.filter("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source_text"), F.lit("new").alias("status"))
    patch = part.filter("p_size <= 30").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("target_text"), F.lit("translated").alias("status"))
    for _ in range(2):
        table.create(rows)
        table.add_columns({"target_text": "string", "qa_score": "double", "updated_at": "timestamp"})
        table.merge(patch, ("target_text", "status"), "2024-05-01 10:00:00")
    return table.read().select("id", "source_text", "status", "target_text", "qa_score", F.col("updated_at").cast("string").alias("updated_at"), F.lit(len(table.numbers())).alias("versions"))


def term_ladder_whole(spark, tables):
    """The whole ladder over bound tables: exact, case folded, close to the
    segment's head (ratio 0.72), words in any order; fifteen a segment."""
    found = run(spark, "term_ladder", tables).filter("match_type IS NOT NULL").select("id", "term", "tier", "match_type")
    close = run(spark, "fuzzy_candidates", tables).filter(ratcliff(F.col("a"), F.col("b"), digits=9) >= 72).select("id", "term", "tier", F.lit("fuzzy").alias("match_type"))
    partial = found.filter("match_type = 'partial' AND length(term) <= 60").join(close.select("id", "term"), ["id", "term"], "left_anti")
    every = found.filter("match_type <> 'partial'").unionByName(partial).unionByName(close)
    kind = F.create_map(*(F.lit(x) for x in ("exact", 0, "case_insensitive", 1, "partial", 2, "fuzzy", 3)))
    score = F.create_map(*(F.lit(x) for x in ("exact", 1.0, "case_insensitive", 0.98, "partial", 0.85, "fuzzy", 0.72)))
    order = F.when(F.col("tier") == "approved", 0).otherwise(10) + kind[F.col("match_type")]
    place = F.row_number().over(Window.partitionBy("id").orderBy(order, F.length("term").desc(), "term"))
    return every.select("id", "term", "tier", "match_type", score[F.col("match_type")].alias("score"), place.alias("rn")).filter("rn <= 15")


def term_match_whole(spark, sf_dir):
    return term_ladder_whole(spark, {t: table(spark, sf_dir, t) for t in tables_of("fuzzy_candidates") | tables_of("term_ladder")})


def queries():
    return {f.__name__: f for f in (term_match_whole, versioned_merge, dup_components, dup_ratcliff_pairs, tsv_round_trip, tmx_round_trip, json_round_trip)}


def oracle_sql():
    pairs = render("dup_fuzzy_pairs", DUCK)
    return {
        "versioned_merge": """SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN p_name END AS source_text, CASE WHEN p_size <= 30 THEN 'translated' ELSE 'new' END AS status, CASE WHEN p_size <= 30 THEN p_brand END AS target_text,
CAST(NULL AS DOUBLE) AS qa_score, CASE WHEN p_size <= 30 THEN '2024-05-01 10:00:00' END AS updated_at, 3 AS versions FROM part WHERE p_size IS NOT NULL""",
        "dup_components": f"WITH RECURSIVE e AS (SELECT * FROM ({pairs}) p), u AS (SELECT a_id AS x, b_id AS y FROM e UNION SELECT b_id, a_id FROM e), r AS (SELECT x, x AS y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x) SELECT x AS id, min(y) AS component FROM r GROUP BY x",
        "tsv_round_trip": "SELECT DISTINCT p_name, p_brand FROM part",
        "tmx_round_trip": "SELECT DISTINCT p_name AS source_text, p_type AS target_text FROM part",
        "json_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    }
