"""How often a query evaluates the routed rows, and rules that count in place."""

import pytest
from conftest import SF

from segq.plans import registry
from segq.plans.core import run

ROOTS = "cardi|neur"


def evaluated(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count(ROOTS)


@pytest.mark.parametrize("name", ["review_stats", "preflight_write_back"])
def test_routed_rows_are_evaluated_once(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    assert evaluated(registry.queries()[name](spark, SF)) == 1


def test_blocks_of_the_batch_order_are_counted_from_its_own_exchange(spark):
    df = registry.queries()["batch_order"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count(ROOTS) == 1


def test_marks_and_words_are_counted_in_place(spark):
    registry._load()
    text = "(((x]] AB; CD, EFG. A.B ABCDEFG [[ {{{{ a/b–c-d | → ← XY\u00a0Z the_cat and neurology cardio-pathologist and"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    r = {x.id: x for x in run(spark, "features", {"documents": docs}).collect()}
    assert [r[1][c] for c in ("n_marks", "n_pipes", "n_nested", "n_separators", "n_parens", "n_abbr", "n_short_caps", "n_roots", "n_words", "n_forbidden_pre")] == [4, 3, 4, 2, 3, 3, 0, 4, 18, 1]
    assert [r[2][c] for c in ("n_marks", "n_nested", "n_abbr", "n_words")] == [0, 0, 0, 0]
