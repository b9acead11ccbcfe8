"""The nested state against rows written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from segq.sources import state as S
from segq.sources.shared import shared_path

COMMENT = {"author": "a", "text": "first"}
PROJECT = {"id": 1, "title": "one", "src": "RU", "tgt": "EN", "segments": [
    {"id": 1, "source": "s1", "target": "", "status": "new", "risk": "low"},
    {"id": 2, "source": "s2", "target": "t2", "status": "confirmed", "risk": "critical", "comments": [COMMENT]},
    {"id": 3, "source": "s3", "target": "t3", "status": "failed", "risk": "high"},
    {"id": 3, "source": "s4", "target": "t4", "status": "review", "risk": "high"},
    {"id": None, "source": "lost"}, {"id": 300, "source": None, "target": None, "status": "review", "risk": None}]}
STATE = {"projects": [PROJECT, {"id": 2, "title": "two", "segments": []}], "glossary": [{"src": "a", "tgt": "x"}, {"src": "b", "tgt": "y"}, {"src": "a", "tgt": "z"}],
         "tm": [{"src": "m", "tgt": "n", "verified": True}, {"src": "o", "tgt": "p"}, {"src": "q", "tgt": "r", "quality": "mt", "verified": True}],
         "exportHistory": [{"file": "old.docx", "when": "then", "size": "1"}]}


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    file = tmp_path_factory.mktemp("state") / "state.json"
    file.write_text(json.dumps(STATE, indent=2))
    return S.from_documents(spark, str(file))


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def cards(state):
    return {r.id: (r.target, r.status, [tuple(c) for c in r.comments or []]) for r in S.segments(state).collect()}


def test_migration(spark, state):
    assert sorted(rows(state.tm, "src", "quality")) == [("m", "verified"), ("o", "draft"), ("q", "mt")]
    assert rows(S.in_order(state.glossary), "src", "tgt") == [("a", "x"), ("b", "y"), ("a", "z")]
    assert sorted(rows(state.projects, "id", "title")) == [(1, "one"), (2, "two")]
    assert {r.part: len(r.segments) for r in state.parts.collect()} == {0: 3, 1: 1}


@pytest.mark.parametrize(("size", "kept"), [(99, 3), (100, 100)])
def test_a_small_glossary_gives_way_to_a_full_one(spark, tmp_path, size, kept):
    (tmp_path / "s.json").write_text(json.dumps(STATE))
    full = spark.range(size).select(*(F.col("id").cast("long" if c == "freq" else "string").alias(c) for c in S.TERM), F.col("id").alias("pos"))
    assert S.from_documents(spark, str(tmp_path / "s.json"), full).glossary.count() == kept


def test_updates_and_reverts(spark, state):
    schema = "project_id long, id long, seq int, target string, status string, author string, comment string"
    patches = [(1, 1, 1, "lost", None, None, None), (1, 1, 2, "text", None, None, "note"), (1, 2, 1, None, "", "b", "second"), (1, 3, 1, " ", "new", None, ""), (1, 9, 1, "x", None, None, None), (None, 1, 1, "x", None, None, None)]
    new = S.update_segments(state, spark.createDataFrame(patches, schema))
    assert cards(new) == {1: ("text", "translated", [("", "note")]), 2: ("t2", "confirmed", [("a", "first"), ("b", "second")]), 3: (" ", "new", []), 300: (None, "review", [])}
    back = S.revert_segments(state, spark.createDataFrame([(1, i) for i in (1, 2, 3, 300, 300)], "project_id long, id long"))
    assert {i: c[:2] for i, c in cards(back).items()} == {1: ("", "new"), 2: ("t2", "translated"), 3: ("", "new"), 300: (None, "review")}


def test_parts_are_rewritten_in_place(spark, state):
    patches = spark.createDataFrame([(1, 1, 1, "x", None, None, None)], "project_id long, id long, seq int, target string, status string, author string, comment string")
    plan = S.update_segments(state, patches).parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 0 and "transform" in plan


def test_terms(spark, state):
    schema = "src string, tgt string, cat string, freq long, conf string, is_new boolean, seq int"
    asked = [("a", "lost", "", 0, "", False, 1), ("a", "A", "c", 5, "High", False, 2), ("b", "B", "", 0, "", True, 3), ("n", "N", "", 0, "", False, 4), (None, "no", "", 0, "", True, 5)]
    new = S.save_terms(state, spark.createDataFrame(asked, schema))
    assert rows(S.in_order(new.glossary), "src", "tgt") == [("n", "N"), ("b", "B"), ("a", "A"), ("b", "y"), ("a", "z")]
    again = S.save_terms(new, spark.createDataFrame([("b", "BB", "", 0, "", None, 1), ("q", "Q", "", 0, "", True, 2)], schema))
    assert rows(S.in_order(again.glossary), "src", "tgt") == [("q", "Q"), ("n", "N"), ("b", "BB"), ("a", "A"), ("b", "y"), ("a", "z")]
    gone = S.without(again, "glossary", spark.createDataFrame([("b",), ("b",), (None,)], "term string"), "src")
    assert rows(S.in_order(gone.glossary), "src", "tgt") == [("q", "Q"), ("n", "N"), ("a", "A"), ("a", "z")]


def test_board_exports_and_projects(spark, state):
    assert sorted(rows(S.board(state), "board_column", "priority", "cards")) == [("confirmed", "urgent", 1), ("new", "low", 1), ("translated", "low", 1)]
    new = S.register_exports(state, spark.createDataFrame([(1, "xlsx", 1), (2, "pdf", 2), (7, "pdf", 3)], "project_id long, format string, seq int"), "now")
    assert rows(S.in_order(new.history), "file", "when") == [("two.pdf", "now"), ("one.xlsx", "now"), ("old.docx", "then")]
    left = S.without(state, "projects", spark.createDataFrame([(1,)], "id long"), "id")
    assert rows(left.projects, "id") == [(2,)] and left.parts.count() == 0


def test_saved_versions(spark, state):
    path = shared_path(spark, "state")
    assert S.load(spark, path, seed=state) is state
    with pytest.raises(ValueError, match="no version"):
        S.load(spark, path)
    assert S.save(spark, state, path) == 1
    assert S.save(spark, S.without(S.load(spark, path), "tm", spark.createDataFrame([("m",)], "src string"), "src"), path) == 2
    assert (S.load(spark, path).tm.count(), S.load(spark, path, 1).tm.count()) == (2, 3)
    assert cards(S.load(spark, path)) == cards(state)
    for name in S.SECTIONS:
        assert getattr(S.load(spark, path, 1), name).exceptAll(getattr(state, name)).count() == 0


def test_seed(spark, state):
    many = S.save_terms(state, spark.range(200).select(F.col("id").cast("string").alias("src"), F.lit("t").alias("tgt"), F.lit("").alias("cat"), F.lit(0).cast("long").alias("freq"), F.lit("").alias("conf"), F.lit(True).alias("is_new"), F.col("id").alias("seq")))
    got = S.seed_dump(many)
    assert [r.src for r in S.in_order(got.glossary).collect()] == [str(i) for i in range(199, 49, -1)] and got.tm.count() == 3


def test_a_saved_state_is_compressed(spark, state, tmp_path):
    number = S.save(spark, state, str(tmp_path / "s"))
    files = [f for f in (tmp_path / "s" / "versions" / str(number)).rglob("part-*") if not f.name.endswith(".crc")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert cards(S.load(spark, str(tmp_path / "s"))) == cards(state)
