"""Versions, dense numbers and alerts against rows written by hand."""

import pytest
from test_rules import TERMS, TURNS, pairs
from test_whole import PART, bound, documents

from segq.sources.shared import shared_path
from segq.sources.versions import Versions


def test_versions(spark):
    table = Versions(spark, shared_path(spark, "t"), "id")
    with pytest.raises(ValueError, match="no version"):
        table.read()
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, t string, s string")
    assert table.create(first) == 1 and table.create(first.limit(0)) == 1
    assert table.add_columns({"updated_at": "string", "T": "string"}) == 2 == table.add_columns({"updated_at": "string"})
    patch = spark.createDataFrame([(2, None), (3, "z"), (3, "w"), (None, "q")], "id long, s string")
    assert table.merge(patch, ("s",), "now") == 3 == table.merge(patch, ("s",), "later")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", "x", None), (2, "b", None, "now"), (3, None, "z", "now")]
    assert sorted(map(tuple, table.read(1).collect())) == [(1, "a", "x"), (2, "b", "y")]
    with pytest.raises(ValueError, match="not allowed"):
        table.merge(first, ("s",), "now")


def test_groups_are_numbered_as_first_seen(spark, monkeypatch):
    monkeypatch.setattr("segq.plans.core.BLOCK", 2)
    names = ["a", "b", "A ", "c", "b", "d", "c", "c"]
    rows = [(10 + 3 * i, n, "b", "t", 1, 1.0) for i, n in enumerate(names)]
    got = sorted(bound(spark, "dup_assign", part=(PART, rows)), key=lambda r: r.id)
    assert [r.group_number for r in got] == [0, 1, 0, 2, 1, None, 2, 2]


def test_places_run_over_all_routes(spark, monkeypatch):
    monkeypatch.setattr("segq.plans.core.BLOCK", 2)
    docs = documents(*((i, t) for i, t in enumerate(["a text", "other words", "a text", "5 mg of it", "more here", "a text"])))
    got = bound(spark, "batch_order", documents=docs, **TERMS)
    assert [r.place for r in sorted(got, key=lambda r: (r.priority, r.id))] == list(range(1, 7))


def test_alerts_list_their_members(spark, monkeypatch):
    monkeypatch.setattr("segq.operators.consistency.MEMBERS", 2)
    rows = [(i, "same", f"b{i % 2}", "t", 1, 1.0) for i in range(1, 40)] + [(99, "other", "b", "t", 1, 1.0)]
    turns = pairs(("see Anna Berta now", "siehe Anna Berta"), ("ask Anna Berta", "frag Berta Anna"), ("an ECG now", "ein EKG"), ("the ECG", "das ECG"))
    tables = {"conversations": turns, "part": (PART, rows), "nation": TERMS["nation"]}
    alerts = bound(spark, "consistency_run", **tables)
    members = {}
    for r in alerts:
        assert 1 <= r.n <= 2 and len(r.members.split()) == r.n
        members.setdefault((r.type, r.key), set()).update(r.members.split())
    assert members["name", "Anna Berta"] == {"p0:0", "p1:0"} and members["abbreviation", "ECG"] == {"p2:0", "p3:0"}
    assert members["group", "g1"] == {f"s{i}" for i in range(1, 40)} and {k for k, _ in members} == {"source", "name", "abbreviation", "group", "term"} - ({"term"} if ("term", "the") not in members else set())
    fans = {r.id: r for r in bound(spark, "alert_fan_out", **tables)}
    assert fans["s1"].types == "group,source" and fans["s1"].alerts == 2 and "s99" not in fans and TURNS
