"""Joins by edit distance and containment against all pairs."""

import random

import pytest

from segq.operators.similarity_join import contained_pairs, edit_pairs
from segq.plans import core, registry
from segq.plans.dialect import SPARK

registry.queries()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts(n=250, seed=9):
    """Words without spaces, so no two share a token; a part is edited."""
    rng = random.Random(seed)
    out = ["medicine", "medicines", "a", "b", "ab", "", "aaaaaaaa", "aaaaaaab"]
    while len(out) < n:
        if rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = rng.choice(["x", "yz", "é", ""])
            t = "".join(t)
        else:
            t = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 26)))
        if t not in out:
            out.append(t)
    return [(i + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("ratio", [0.6, 0.75, 0.9])
def test_edit_join_loses_no_pair(spark, monkeypatch, ratio):
    monkeypatch.setattr("segq.operators.similarity_join.SLOT", 20)  # frequent grams in several slots
    rows = texts()
    spark.createDataFrame(rows, "id long, t string").createOrReplaceTempView("some_texts")
    got = spark.sql(edit_pairs(SPARK, "some_texts", "some_texts", ratio)).filter("a_id < b_id").collect()
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and min(len(a), len(b)) >= ratio * max(len(a), len(b)):
                s = 1 - distance(a, b) / max(len(a), len(b))
                if s >= ratio:
                    want[i, j] = s
    assert {(r.a_id, r.b_id) for r in got} == set(want) and len(got) == len(want) > 20
    assert all(abs(r.similarity - want[r.a_id, r.b_id]) < 1e-9 for r in got)


def test_containment_join_is_all_pairs(spark, monkeypatch):
    monkeypatch.setattr("segq.operators.similarity_join.SLOT", 20)
    left, right = texts(120, 1), [(1000 + i, t + "-" + u) for (i, t), (_, u) in zip(texts(90, 2), texts(120, 1))]
    spark.createDataFrame(left, "id long, t string").createOrReplaceTempView("some_left")
    spark.createDataFrame(right, "id long, t string").createOrReplaceTempView("some_right")
    got = [(r.a_id, r.b_id) for r in spark.sql(contained_pairs(SPARK, "some_left", "some_right")).collect()]
    want = {(i, j) for i, a in left for j, b in right if a and a in b}
    assert set(got) == want and len(got) == len(want)


def test_pairs_without_a_common_token_are_found(spark):
    part = spark.createDataFrame([(1, "medicine", "T1", "B", 1, 1.0), (2, "medicines", "T2", "B", 1, 1.0), (3, "Medicine ", "T", "B", 1, 1.0)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double")
    got = core.run(spark, "dup_fuzzy_pairs", {"part": part}).collect()
    assert [(r.a_id, r.b_id, r.similarity) for r in got] == [(1, 2, 0.889)]


def test_memory_scores_are_layered(spark):
    names = ["left knee", "the left knee", "left knees", "elbow", "left kne"]
    part = spark.createDataFrame([(i, n, t, "B", 1, 1.0) for i, (n, t) in enumerate(zip(names, ["left knee", "left knee joint", "elbow", "elbow", "elbow"]))], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double")
    got = {(r.id, r.tm_id): r.score for r in core.run(spark, "tm_scored", {"part": part}).collect()}
    # entries: 0 'left knee', 1 'left knee joint', 2 'elbow'
    assert got == {(0, 0): 100, (0, 1): 70 + 26 * 9 // 15, (1, 0): 96, (2, 0): 96, (3, 2): 100, (4, 0): 70 + 26 * 8 // 9, (4, 1): 70 + 26 * 8 // 15}


def test_bound_tables_leave_the_session_alone(spark):
    spark.range(3).createOrReplaceTempView("part")
    part = spark.createDataFrame([(1, "x", "T", "B", 1, 1.0)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double")
    assert core.run(spark, "dup_assign", {"part": part}).count() == 1 and spark.table("part").count() == 3
    spark.catalog.dropTempView("part")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("part_")]


def test_few_texts_are_looked_for_row_by_row_and_many_by_key(spark, monkeypatch):
    from test_whole import documents

    from segq.operators import similarity_join

    left, right = texts(60, 3), [(1000 + i, t + " " + u) for (i, t), (_, u) in zip(texts(60, 4), texts(60, 5))]
    spark.createDataFrame(left, "id long, t string").createOrReplaceTempView("few_left")
    spark.createDataFrame(right, "id long, t string").createOrReplaceTempView("few_right")
    one = spark.sql("SELECT * FROM (VALUES ('larger'), ('in vitro'), ('  ')) v(term)")
    tables = {"nation": spark.createDataFrame([("FRANCE",)], "n_name string"), "part": spark.createDataFrame([("large ring",)], "p_name string"), "approved_terms": one}
    schema, rows = documents((1, "Larger rings"), (2, "a larges\tIN  VITROS"), (3, 'say "largest'), (4, None), (5, "enlarge it  in vitro"))
    tables["documents"] = spark.createDataFrame(rows, schema)
    got = []
    for limit in (256, 0):
        monkeypatch.setattr(similarity_join, "FEW", limit)
        pairs = spark.sql(contained_pairs(SPARK, "few_left", "few_right"))
        stems = core.run(spark, "term_stem", tables)
        got.append((sorted((r.a_id, r.b_id) for r in pairs.collect()), sorted(tuple(r) for r in stems.collect())))
    assert got[0] == got[1]
    assert got[0][0] == sorted((i, j) for i, a in left for j, b in right if a and a in b)
    assert got[0][1] == [(1, "large", "large"), (1, "larger", "larger"), (2, "  ", "  "), (2, "in vitro", "in  vitros"), (2, "large", "large"), (2, "larger", "larges"), (3, "large", "large"), (5, "  ", "  "), (5, "in vitro", "in vitro"), (5, "large", "large")]
