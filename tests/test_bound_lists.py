"""Lists that arrive as tables: any relation can be bound."""

import pytest
from test_whole import PART, documents

from segq.plans import registry
from segq.plans.core import run, tables_of


@pytest.fixture(scope="module", autouse=True)
def _loaded():
    registry._load()


def test_a_relation_is_bound(spark):
    assert "forbidden" not in tables_of("forbidden_pre") and "forbidden" in tables_of("forbidden_pre", {"forbidden"})
    segments = spark.createDataFrame([(1, "a bad word here"), (2, "badword"), (3, "two words in one")], "id long, source_text string")
    forbidden = spark.createDataFrame([(i, f"term{i}", f"t{i}", "r") for i in range(3000)] + [(3000, "bad", "worse", "r"), (3001, "two words", "pair", "r")], "pos long, term string, bad string, reason string")
    glossary = spark.createDataFrame([("bad", "approved", "good; GOOD")], "term string, tier string, target string")
    found = run(spark, "forbidden_pre", {"segments": segments, "forbidden": forbidden, "glossary": glossary}).select("id").collect()
    assert sorted(r.id for r in found) == [1, 3]


def test_approved_terms_as_a_table(spark):
    tables = {"nation": spark.createDataFrame([("ALGERIA",)], "n_name string"), "part": spark.createDataFrame([(1, "brass plate", "b", "t", 1, 1.0)], PART), "approved_terms": spark.createDataFrame([("Brass",), ("x",), (None,)], "term string")}
    assert sorted(map(tuple, run(spark, "glossary", tables).select("term", "tier").collect())) == [("algeria", "reference"), ("brass", "approved")]


@pytest.mark.parametrize("pairs", [[], [("plate", "b#8")], [("plate", "b#8"), ("brass", "b#8"), ("nothing", "c")]])
def test_dangerous_pairs_as_a_table(spark, pairs):
    rows = spark.createDataFrame([(1, "brass plate", "B#8", "high"), (2, "iron ring", "b#8", "high"), (3, None, None, "low")], "pos long, ru string, en string, confidence string")
    tables = {"term_rows": rows, "dangerous_pairs": spark.createDataFrame(pairs, "key string, bad string")}
    assert [r.pos for r in run(spark, "dangerous_mappings", tables).collect()] == [1] * sum(k in "brass plate" for k, _ in pairs)
    verdicts = {r.pos: r.verdict for r in run(spark, "final_clean", tables).collect()}
    assert (verdicts[1] == "dangerous") == bool(pairs) and verdicts[2] != "dangerous" and len(verdicts) == 3


def test_the_text_of_the_session_stays(spark):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("forbidden")
    docs = spark.createDataFrame(*reversed(documents((1, "the one"))))
    registry.queries()
    assert run(spark, "segments", {"documents": docs}).count() >= 1 and spark.table("forbidden").columns == ["x"]
    spark.catalog.dropTempView("forbidden")
