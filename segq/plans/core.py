"""Named relations: definition, dependencies and rendering.

``@relation("a", "b")`` names a function of a dialect as a relation that reads
the relations or tables a and b.  Rendering a relation collects what it needs
as common table expressions; Catalyst sees one query and prunes and pushes
down across all of it.  ``run`` binds base tables (any DataFrames with the
documented columns) to a relation.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Container

from pyspark.sql import DataFrame, SparkSession

from segq.functions.lexicons import using
from segq.plans.dialect import DUCK, SPARK

#: Tables of the test data; an application binds its own under these names.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS: dict[str, tuple[Callable, tuple[str, ...], bool]] = {}


def relation(*needs: str, query: bool = True):
    def add(f: Callable) -> Callable:
        RELATIONS[f.__name__] = (f, needs, query)
        return f

    return add


#: Ids of a block that is numbered in one task.
BLOCK = 4096


def dense(rel: str, key: str, *before: str) -> str:
    """SELECT of ``rel`` and the place of each row, from 1, in the order of the
    columns ``before`` and of the whole number ``key``.  A block is a range of
    keys; blocks are counted, counts summed in order (one row a block), and rows
    numbered inside their block."""
    block = f"SELECT *, CAST(floor({key} / {BLOCK}e0) AS BIGINT) AS block FROM {rel} numbered"
    parts = ", ".join([*before, "block"])
    same = " AND ".join(f"b.{c} = o.{c}" for c in [*before, "block"])
    sizes = f"SELECT {parts}, count(*) AS size FROM ({block}) s GROUP BY {parts}"
    offsets = f"SELECT {parts}, sum(size) OVER (ORDER BY {parts} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM ({sizes}) z"
    inner = ", ".join(f"b.{c}" for c in [*before, "block"])
    return f"SELECT b.*, CAST(o.ahead + row_number() OVER (PARTITION BY {inner} ORDER BY b.{key}) AS BIGINT) AS place FROM ({block}) b JOIN ({offsets}) o ON {same}"


def order(name: str, bound: Container[str] = (), seen: list[str] | None = None) -> list[str]:
    """The relation's dependencies, innermost first, then itself; those that
    are bound to tables count as tables."""
    seen = [] if seen is None else seen
    if name in RELATIONS and name not in bound and name not in seen:
        for need in RELATIONS[name][1]:
            order(need, bound, seen)
        seen.append(name)
    return seen


def tables_of(name: str, bound: Container[str] = ()) -> set[str]:
    return {need for part in order(name, bound) for need in RELATIONS[part][1] if need not in RELATIONS or need in bound}


def render(name: str, dialect=SPARK, bound: Container[str] = ()) -> str:
    *inner, last = order(name, bound)
    text = RELATIONS[last][0](dialect)
    if not inner:
        return text
    recursive = "RECURSIVE " if any("/*recursive*/" in RELATIONS[r][0](dialect) for r in [*inner, last]) else ""
    return f"WITH {recursive}" + ",\n".join(f"{r} AS ({RELATIONS[r][0](dialect)})" for r in inner) + f"\n{text}"


def run(spark: SparkSession, name: str, tables: dict[str, DataFrame], **lists) -> DataFrame:
    """The relation over the tables given (by name), with other word lists in
    place of the defaults (``UNITS=("mg",)``).  A table given under the name of
    a relation inside this one takes its place: ``forbidden``, ``glossary``,
    ``approved_terms`` or ``dangerous_pairs`` may be files of any size.  Tables
    are bound for this text alone: views of the session keep their names and
    contents."""
    bound = set(tables) - {name}
    with using(**lists):
        text = render(name, bound=bound)
    own = {need: f"{need}_{uuid.uuid4().hex}" for need in sorted(tables_of(name, bound))}
    for need, view in own.items():
        tables[need].createOrReplaceTempView(view)
    try:
        views = ",\n".join(f"{need} AS (SELECT * FROM {view})" for need, view in own.items())
        if views:
            kind, rest = re.match(r"(WITH (?:RECURSIVE )?)?(.*)", text, re.S).groups()
            text = f"{kind}{views},\n{rest}" if kind else f"WITH {views}\n{text}"
        return spark.sql(text)
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)


#: Tables of long texts; the key that deals their rows out.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  One of long texts whose files have fewer splits
    than the session has cores is dealt out, as rules cost far more than the
    shuffle of so few splits; a larger one stays as its files are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, TEXTS[name]) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(name: str):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, name, {t: table(spark, sf_dir, t) for t in tables_of(name)})

        return query

    return {name: make(name) for name, (_, _, query) in RELATIONS.items() if query}


def oracle_texts() -> dict[str, str]:
    return {name: render(name, DUCK) for name, (_, _, query) in RELATIONS.items() if query}
