"""The corpus pipeline: five stages, each one an operator of segq.llm.

Every stage takes (spark, docs, sf_dir); all but the last return the columns
of documents, under their names, whatever those are.

Null and empty texts: the toxicity stage scores them by the model's bias and
keeps them (a bias above the threshold would need two labels of three toxic);
they have no shingles and no words, so the next two stages keep them; the mix
takes them as often as its source's whole copies ask, and no more; the token
files give them the end id alone.  Rows that repeat id and text share their
fate in every stage; rows without an id are in no group of near copies.  An
empty table passes every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segq.llm import decontaminate, mixing, ngram_join, registry, token_files, toxicity
from segq.llm.common import drop, fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh("score", docs)
    return toxicity.with_score(docs, model, name=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the smallest id.
    Documents without an id or without words are in no group and stay."""
    copies = ngram_join.ngram_join(docs).filter("n_shingles > 0 and doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone."""
    hits = fresh("hits", docs)
    found = decontaminate.decontamination(docs, table(spark, sf_dir, "benchmark"), name=hits)
    return found.filter(~F.col(f"{hits}.contaminated")).drop(hits)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold per document."""
    return token_files.token_files(docs, registry.tokenizer_path(), keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

#: SQL cannot express the learnt model, the join's method or the files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
        if before is not None:  # what a stage returns is written, so its input can go
            drop(before)
        before = docs
    return docs
