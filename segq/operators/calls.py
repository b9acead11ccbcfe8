"""Questions to language models: prompts as columns, answers as typed JSON.

A model is a function from a list of prompts to a list of answers, called on
the executors once a batch (``mapInPandas``), like a provider of translations.
Prompts are SQL expressions, answers are read by ``from_json`` and checked; an
answer that is missing, malformed or out of its range gives the stated
fallback, never an error.  Null texts are empty.  The ``stub_`` models answer
without any service, and every seventh prompt length with no JSON at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from segq.functions import lexicons as L
from segq.operators.providers import bound
from segq.plans.core import render
from segq.plans.dialect import DUCK

Model = Callable[[list[str]], list[str | None]]

#: Prompts; names in braces are columns.
PROMPTS = {
    "translate": "Translate into the target language, keep numbers and units. Terms: {terms} Text: {source}",
    "qa": "Score accuracy, terms, completeness and numbers of a translation from 0 to 100, as JSON. Source: {source} Target: {target}",
    "back": "Translate back into the source language and list what drifted, is missing or was added, as JSON. Source: {source} Target: {target}",
    "terms": "List new terms with translation, category and confidence, as JSON. Text: {source}",
    "safety": "Decide whether a person may confirm this translation unseen, as JSON. Source: {source} Target: {target} Checks: {qa} Back translation: {back}",
    "review": "Review a proposed term. Term: {source} Translation: {target}",
}


def prompt(name: str, **columns: str) -> str:
    """The prompt as a SQL expression; ``columns`` are expressions as well."""
    text = PROMPTS[name]
    for key, column in columns.items():
        text = text.replace(f"{{{key}}}", f"' || coalesce({column}, '') || '")
    return f"('{text}')"


def ask(rows: DataFrame, question: str, model: Model, name: str = "answer", batch: int = 50) -> DataFrame:
    """``rows`` with the model's answer to each row's question (SQL)."""

    def answers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            asked = pdf[name].tolist()
            yield pdf.assign(**{name: [x for at in range(0, len(asked), batch) for x in model(asked[at : at + batch])]})

    rows = rows.withColumn(name, F.expr(question).cast("string"))
    return rows.mapInPandas(answers, StructType([StructField(f.name, f.dataType) for f in rows.schema]))  # an answer may be null


def parsed(answer: Column, schema: str) -> Column:
    return F.from_json(answer, schema, {"mode": "PERMISSIVE"})


def score_or(score: Column, other: float) -> Column:
    """The score if it is from 0 to 100, else the fallback."""
    return F.when(score.between(0, 100), score).otherwise(F.lit(other))


def _stub(make: Callable[[int], object]) -> Model:
    return lambda asked: ["no answer" if len(q) % 7 == 0 else json.dumps(make(len(q))) for q in asked]


stub_qa = _stub(lambda n: {"overall_score": 60 + n % 50, "verdict": "pass"})
stub_back = _stub(lambda n: {"back_translation": f"back {n}", "semantic_score": 50 + n % 50, "verdict": "pass" if n % 2 else "fail"})
stub_terms = _stub(lambda n: {"terms": [{"source_term": f"term {n % 5}", "target_term": f"T{n % 5}", "category": "other", "confidence": 0.5}, {"source_term": "open", "target_term": "", "category": "other", "confidence": 0.5}]})
stub_safety = _stub(lambda n: {"safety_status": "safe_to_confirm" if n % 2 else "certainly", "reason": "stub"})


def stub_text(asked: list[str]) -> list[str | None]:
    return [f"reviewed {len(q)}" for q in asked]


QA, BACK = "overall_score double, verdict string", "back_translation string, semantic_score double, verdict string"
TERMS, SAFETY = "terms array<struct<source_term: string, target_term: string, category: string, confidence: double>>", "safety_status string, reason string"
STATES = ("safe_to_confirm", "needs_review", "high_risk")


def qa_report(pairs: DataFrame, model: Model, forbidden: tuple = L.FORBIDDEN) -> DataFrame:
    """id, score, verdict, forbidden_hits.  Without a valid answer: 50 and
    'warning'.  Each forbidden wording in the target takes 20 points, down to
    none, and fails the row."""
    rows = ask(pairs, prompt("qa", source="source_text", target="target_text"), model).withColumn("a", parsed("answer", QA))
    target = F.lower(F.coalesce("target_text", F.lit("")))
    hits = sum((target.contains(bad.lower()).cast("long") for _, bad, _ in forbidden), F.lit(0).cast("long"))
    rows = rows.withColumn("score", score_or(F.col("a.overall_score"), 50.0)).withColumn("forbidden_hits", hits)
    verdict = F.when(F.col("forbidden_hits") > 0, "failed").when(F.col("a.overall_score").between(0, 100), F.coalesce("a.verdict", F.lit("warning"))).otherwise("warning")
    return rows.select("id", F.greatest(F.lit(0.0), F.col("score") - 20 * F.col("forbidden_hits")).alias("score"), verdict.alias("verdict"), "forbidden_hits")


def back_check(pairs: DataFrame, model: Model) -> DataFrame:
    """id, back_translation, score, verdict; else '', 50 and 'warning'."""
    rows = ask(pairs, prompt("back", source="source_text", target="target_text"), model).withColumn("a", parsed("answer", BACK))
    good = F.col("a.semantic_score").between(0, 100) & F.col("a.back_translation").isNotNull()
    pick = lambda c, other: F.when(good, F.col(c)).otherwise(F.lit(other))
    return rows.select("id", pick("a.back_translation", "").alias("back_translation"), pick("a.semantic_score", 50.0).alias("score"), F.coalesce(pick("a.verdict", "warning"), F.lit("warning")).alias("verdict"))


def valid_terms(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys and (source_term, target_term) of answers; both sides set."""
    terms = rows.select(*keys, F.explode(parsed("answer", TERMS)["terms"]).alias("t")).select(*keys, "t.source_term", "t.target_term")
    return terms.filter("trim(coalesce(source_term, '')) <> '' and trim(coalesce(target_term, '')) <> ''")


def safety(pairs: DataFrame, reports: DataFrame, backs: DataFrame, model: Model) -> DataFrame:
    """id, safety_status; 'needs_review' unless the answer is a known state."""
    rows = pairs.join(reports.select("id", F.col("verdict").alias("qa_verdict")), "id").join(backs.select("id", F.col("verdict").alias("back_verdict")), "id")
    rows = ask(rows, prompt("safety", source="source_text", target="target_text", qa="qa_verdict", back="back_verdict"), model)
    status = parsed("answer", SAFETY)["safety_status"]
    return rows.select("id", F.when(status.isin(*STATES), status).otherwise("needs_review").alias("safety_status"))


def batched_terms(pairs: DataFrame, model: Model, size: int = 8) -> DataFrame:
    """Terms from batches of a project's pairs in order, one call a batch:
    (source_term, target_term, batches that name it)."""
    place = F.row_number().over(Window.partitionBy("project").orderBy("turn", "source_text", "target_text")) - 1
    lines = pairs.select("project", place.alias("place"), F.concat_ws(" = ", F.coalesce("source_text", F.lit("")), F.coalesce("target_text", F.lit(""))).alias("line"))
    grouped = lines.groupBy("project", F.floor(F.col("place") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    asked = ask(grouped.select("project", "part", F.array_join("lines.line", " ; ").alias("lines")), prompt("terms", source="lines"), model)
    return valid_terms(asked, "project", "part").groupBy("source_term", "target_term").agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "pairs", "conversations")


def qa_call(spark, sf_dir):
    return qa_report(_pairs(spark, sf_dir), stub_qa)


def backcheck_call(spark, sf_dir):
    return back_check(_pairs(spark, sf_dir), stub_back)


def safety_call(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).groupBy("id").agg(F.min("source_text").alias("source_text"), F.min("target_text").alias("target_text"))
    return safety(pairs, qa_report(pairs, stub_qa), back_check(pairs, stub_back), stub_safety)


def term_extraction(spark, sf_dir):
    return valid_terms(ask(_pairs(spark, sf_dir), prompt("terms", source="source_text"), stub_terms), "id")


def term_extraction_batches(spark, sf_dir):
    return batched_terms(_pairs(spark, sf_dir), stub_terms)


def glossary_review_call(spark, sf_dir):
    terms = bound(spark, sf_dir, "glossary", "nation", "part").withColumn("source", F.col("term"))
    return ask(terms, prompt("review", source="source", target="target"), stub_text, "review").select("term", "review")


def translate_prompt(spark, sf_dir):
    """The prompt of each pair; its terms are those of the forbidden pairs."""
    terms = ", ".join(term for term, _, _ in L.FORBIDDEN)
    return _pairs(spark, sf_dir).select("id", F.expr(prompt("translate", source="source_text", terms=f"'{terms}'")).alias("prompt"))


def queries():
    return {f.__name__: f for f in (qa_call, backcheck_call, safety_call, term_extraction, term_extraction_batches, glossary_review_call, translate_prompt)}


def oracle_sql():
    pairs = render("pairs", DUCK)
    both = {"source": "source_text", "target": "target_text"}
    hits = " + ".join(f"CASE WHEN contains(lower(target_text), '{bad.lower()}') THEN 1 ELSE 0 END" for _, bad, _ in L.FORBIDDEN)
    qa = lambda src: f"SELECT id, greatest(0, CASE WHEN n % 7 > 0 AND 60 + n % 50 <= 100 THEN 60 + n % 50 ELSE 50 END - 20 * hits)::DOUBLE AS score, CASE WHEN hits > 0 THEN 'failed' WHEN n % 7 > 0 AND 60 + n % 50 <= 100 THEN 'pass' ELSE 'warning' END AS verdict, hits AS forbidden_hits FROM (SELECT id, length({prompt('qa', **both)}) AS n, {hits} AS hits FROM ({src}) p) t"
    back = lambda src: f"SELECT id, CASE WHEN n % 7 > 0 THEN 'back ' || n ELSE '' END AS back_translation, CASE WHEN n % 7 > 0 THEN 50 + n % 50 ELSE 50 END::DOUBLE AS score, CASE WHEN n % 7 = 0 THEN 'warning' WHEN n % 2 = 1 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT id, length({prompt('back', **both)}) AS n FROM ({src}) p) t"
    single = f"SELECT id, min(source_text) AS source_text, min(target_text) AS target_text FROM ({pairs}) p GROUP BY id"
    decided = f"SELECT p.id, length({prompt('safety', source='p.source_text', target='p.target_text', qa='q.verdict', back='b.verdict')}) AS n FROM ({single}) p JOIN ({qa(single)}) q ON p.id = q.id JOIN ({back(single)}) b ON p.id = b.id"
    lines = f"SELECT project, row_number() OVER (PARTITION BY project ORDER BY turn, source_text, target_text) - 1 AS place, source_text || ' = ' || target_text AS line FROM ({pairs}) p"
    batches = f"SELECT length({prompt('terms', source='lines')}) AS n FROM (SELECT string_agg(line, ' ; ' ORDER BY place) AS lines FROM ({lines}) l GROUP BY project, place // 8) g"
    return {
        "qa_call": qa(pairs),
        "backcheck_call": back(pairs),
        "safety_call": f"SELECT id, CASE WHEN n % 7 > 0 AND n % 2 = 1 THEN 'safe_to_confirm' ELSE 'needs_review' END AS safety_status FROM ({decided}) d",
        "term_extraction": f"SELECT id, 'term ' || n % 5 AS source_term, 'T' || n % 5 AS target_term FROM (SELECT id, length({prompt('terms', source='source_text')}) AS n FROM ({pairs}) p) t WHERE n % 7 > 0",
        "term_extraction_batches": f"SELECT 'term ' || n % 5 AS source_term, 'T' || n % 5 AS target_term, count(*) AS n FROM ({batches}) b WHERE n % 7 > 0 GROUP BY 1, 2",
        "glossary_review_call": f"SELECT term, 'reviewed ' || length({prompt('review', source='term', target='target')}) AS review FROM ({render('glossary', DUCK)}) g",
        "translate_prompt": f"SELECT id, {prompt('translate', source='source_text', terms=chr(39) + ', '.join(w for w, _, _ in L.FORBIDDEN) + chr(39))} AS prompt FROM ({pairs}) p",
    }
