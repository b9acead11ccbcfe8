"""Translation through pluggable providers: batches of rows in ``mapInPandas``.

A provider is a function from a list of texts to a list of texts (None where it
has no answer); it runs on the executors, once a batch, so that a remote
service sees few calls.  ``stub`` answers without any service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segq.plans.core import render, run, table
from segq.plans.dialect import DUCK

Provider = Callable[[list[str]], list[str | None]]


def stub(texts: list[str]) -> list[str | None]:
    """Upper case; no answer for texts under five characters."""
    return [t.upper() if len(t) >= 5 else None for t in texts]


def translate(rows: DataFrame, provider: Provider, text_col: str = "source_text", fallback: Provider | None = None, protect: dict[str, str] | None = None, batch: int = 50) -> DataFrame:
    """``rows`` with target and provider ('main', 'fallback' or 'none').

    Surface forms in ``protect`` are replaced by tokens before the call and
    come back as their targets.  Texts without an answer go to the fallback.
    Null texts are empty; blank ones are not sent and get an empty target."""
    tokens = [(form, f"\ue000{i}\ue001", put) for i, (form, put) in enumerate(sorted((protect or {}).items(), key=lambda x: -len(x[0])))]

    def asked(texts: list[str], ask: Provider) -> list[str | None]:
        sent = []
        for t in texts:
            for form, token, _ in tokens:
                t = t.replace(form, token)
            sent.append(t)
        out = [x for at in range(0, len(sent), batch) for x in ask(sent[at : at + batch])]
        for k, x in enumerate(out):
            for _, token, put in tokens:
                x = x.replace(token, put) if x is not None else None
            out[k] = x
        return out

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = pdf[text_col].fillna("").tolist()
            target, who = ["" for _ in texts], ["none" for _ in texts]
            open_ = [i for i, t in enumerate(texts) if t.strip()]
            for name, ask in (("main", provider), ("fallback", fallback)):
                if ask is None or not open_:
                    continue
                for i, x in zip(open_, asked([texts[i] for i in open_], ask)):
                    if x is not None:
                        target[i], who[i] = x, name
                open_ = [i for i in open_ if who[i] == "none"]
            yield pdf.assign(target=target, provider=who)

    schema = rows.withColumns({"target": F.lit(""), "provider": F.lit("")}).schema
    return rows.mapInPandas(batches, schema)


def bound(spark: SparkSession, sf_dir: str, name: str, *tables: str) -> DataFrame:
    return run(spark, name, {t: table(spark, sf_dir, t) for t in tables})


def translate_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory first, then the provider, then the fallback."""
    segments = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source_text"))
    known = bound(spark, sf_dir, "memory_types", "part").select(F.col("t"), F.col("target").alias("tm_target"))
    joined = segments.join(known, F.lower("source_text") == F.col("t"), "left").drop("t")
    out = translate(joined.filter("tm_target is null"), stub, fallback=lambda texts: [f"[{t}]" for t in texts])
    return out.select("id", "target", "provider").unionByName(joined.filter("tm_target is not null").select("id", F.col("tm_target").alias("target"), F.lit("memory").alias("provider")))


def mt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translate new rows of low risk, check locally: draft or needs review."""
    rows = bound(spark, sf_dir, "short_segments", "part").filter("status = 'new' and risk_level = 'LOW'").select("id", "source_text")
    done = translate(rows, stub)
    bad = (F.length(F.trim("target")) < 1) | (F.length("target") > 2 * F.length("source_text"))
    return done.select("id", "target", F.when(bad, "google_needs_review").otherwise("google_draft").alias("status"))


def gpt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translate by group of risk and type; tokens accounted by group."""
    rows = bound(spark, sf_dir, "short_segments", "part").filter("status = 'new' and risk_level <> 'LOW'").select("id", "source_text", "risk_level", "block_type")
    done = translate(rows, stub).withColumn("tokens", F.floor(F.length("source_text") / F.lit(4.0)) + F.floor(F.length("target") / F.lit(4.0)) + 500)
    return done.groupBy("risk_level", "block_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_if(F.col("target") != "").alias("answered"))


def queries():
    return {f.__name__: f for f in (translate_one, mt_batch, gpt_batch)}


def oracle_sql():
    short = render("short_segments", DUCK)
    up = "CASE WHEN length(source_text) >= 5 THEN upper(source_text) ELSE '' END"
    return {
        "translate_one": f"WITH m AS ({render('memory_types', DUCK)}) SELECT p_partkey AS id, coalesce(m.target, CASE WHEN length(p_name) >= 5 THEN upper(p_name) ELSE '[' || p_name || ']' END) AS target, CASE WHEN m.target IS NOT NULL THEN 'memory' WHEN length(p_name) >= 5 THEN 'main' ELSE 'fallback' END AS provider FROM part LEFT JOIN m ON lower(p_name) = m.t",
        "mt_batch": f"SELECT id, {up} AS target, CASE WHEN length({up}) < 1 THEN 'google_needs_review' ELSE 'google_draft' END AS status FROM ({short}) s WHERE status = 'new' AND risk_level = 'LOW'",
        "gpt_batch": f"SELECT risk_level, block_type, count(*) AS n, CAST(sum(floor(length(source_text) / 4.0) + floor(length({up}) / 4.0) + 500) AS BIGINT) AS tokens, count_if({up} <> '') AS answered FROM ({short}) s WHERE status = 'new' AND risk_level <> 'LOW' GROUP BY risk_level, block_type",
    }
