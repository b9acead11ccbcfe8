"""Issues of pairs, batches by state and prices, against rows written by hand."""

import pytest
from test_rules import pairs
from test_whole import PART, bound, documents

from segq.plans import registry
from segq.plans.core import run

GLOSSARY = {"nation": ("n_nationkey int, n_name string", [(1, "FRANCE")]), "part": (PART, [(1, "ring", "b", "t", 1, 1.0)])}


def found(spark, *rows, **tables):
    got = bound(spark, "qa_issues", conversations=pairs(*rows), **{**GLOSSARY, **tables})
    return sorted((int(r.id.split(":")[0]), r.type, r.severity) for r in got if r.type != "glossary_violation")


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ("5 mg", "5 mg", set()),
        ("", "5 mg", set()),  # a source without numbers asks for none
        ("5,5 мг утром", "5,5 in the morning", {("unit_mismatch", "major"), ("weak_collocation", "minor")}),
        ("120 мм рт. ст. и 3 см", "120 and 4", {("number_unit_dosage_mismatch", "critical"), ("unit_mismatch", "major")}),
        ("5 mgs", "5", set()),  # a unit ends where its word ends
        ("не найдено", "found", {("negation_shift", "critical")}),
        ("найдено", "negative  for it", {("negation_shift", "critical")}),
        ("не выявлено", "not identified", set()),
        ("Левый отдел", "the left part", set()),
        ("Левый отдел", "the part", {("laterality_shift", "major")}),
        ("Левый отдел", "the RIGHT part", {("laterality_shift", "critical")}),
        ("Левый и внешний", "external, bright", {("laterality_shift", "major")}),  # bright isn't right
        ("верхний", "lower", {("upper_lower_shift", "critical")}),
        ("распад", "Decayed bay-like", {("terminology", "major"), ("literal_calque", "major")}),
    ],
)
def test_issues(spark, source, target, want):
    assert {x[1:] for x in found(spark, (source, target))} == want


def test_fields_of_an_issue(spark):
    got = bound(spark, "qa_issues", conversations=pairs(("слева", "hearth in right")), **GLOSSARY)
    rows = {r.type: r for r in got}
    assert set(rows) == {"laterality_shift", "terminology"}
    assert (rows["laterality_shift"].source_fragment, rows["laterality_shift"].target_fragment, rows["laterality_shift"].detected_by) == ("левый, левая", "left", "deterministic_validator")
    assert (rows["terminology"].bad_fragment, rows["terminology"].suggested_fragment, rows["terminology"].source_fragment) == ("hearth", "focus", "очаг")
    assert {(r.engine, r.status, r.created_at) for r in got} == {("deterministic", "open", "2024-05-01T10:00:00Z")}


def test_glossary_rule(spark):
    registry._load()
    frame = spark.createDataFrame
    glossary = frame([("очаг", "approved", "focus; lesion"), ("нос", "approved", "rhinion"), ("лоб", "approved", "sugar / x"), ("рука", "approved", "arm or hand"), ("нога", "reference", "leg"), ("пол", "approved", " ; ")], "term string, tier string, target string")
    turns, rows = pairs(("очаг", "a lesion"), ("очаг", "lesions"), ("нос", "z"), ("лоб", "z"), ("рука", "Hand"), ("рука", "handy"), ("нога", "z"), ("пол", "z"), (None, None))
    got = run(spark, "qa_issues", {"conversations": frame(rows, turns), "glossary": glossary}).collect()
    assert sorted((r.id, r.type, r.suggested_fragment) for r in got) == [("1:0", "glossary_violation", "focus; lesion"), ("5:0", "glossary_violation", "arm or hand")]


def test_rules_as_tables(spark):
    registry._load()
    frame = spark.createDataFrame
    text = "pos int, rule string, type string, label string, kind string, phrase string"
    rules = [(4 * i + j, f"r{i}", "made_up", "this", kind, f"{kind} {i}") for i in range(2000) for j, kind in enumerate(("source", "expected", "opposite"))] + [(9000, "r7", "made_up", "this", "expected", None), (9001, "r7", "made_up", "this", "source", "Source  7")]
    turns, rows = pairs(("source 7", "opposite 7"), ("a source 1999.", "expected 1999"), ("source 12", "opposite 13"), ("source 77", ""))
    empty = {"style_rules": frame([], "bad string, preferred string, source_phrase string, type string, severity string, explanation string"), "negations": frame([], "side string, phrase string"), "glossary": frame([], "term string, tier string, target string")}
    tables = {"conversations": frame(rows, turns), "pair_rules": frame(rules, text), **empty}
    got = run(spark, "qa_issues", tables).collect()
    assert sorted((r.id, r.severity) for r in got if r.type == "made_up") == [("0:0", "critical"), ("2:0", "major"), ("3:0", "major")]
    tables["pair_rules"] = frame([], text)
    assert [r for r in run(spark, "qa_issues", tables).collect() if r.type == "made_up"] == []


def test_risk_of_issues(spark):
    rows = (("5", "6"), ("очаг", "hearth"), ("x", "decay hearth"), ("слева", "y"), ("a", "b"), ("c", "in the"))
    verdicts = ("id string, equivalent boolean", [("4:0", False), ("5:0", True)])
    got = {int(r.id.split(":")[0]): (r.risk, r.color, r.human_review_required, r.auto_revision_allowed) for r in bound(spark, "qa_issue_risk", conversations=pairs(*rows), meaning_verdicts=verdicts, **GLOSSARY)}
    assert got == {0: (50, "red", True, False), 1: (30, "yellow", False, True), 2: (60, "yellow", False, True), 3: (30, "red", True, False), 4: (30, "yellow", False, True), 5: (5, "green", False, False)}


STATE = "id long, status string, target_text string, qa_passed boolean, hallucination boolean"
ROUTED = "id long, source_text string, route string, safe_confidence double, level string, n_forbidden_post long, n_numbers long"


def test_batches_read_the_state(spark):
    routed = [(i, "text", "GOOGLE_SAFE", 0.99, "LOW", 0, 0) for i in range(6)] + [(6, "text", "GOOGLE_SAFE", 0.5, "LOW", 0, 0), (7, "abcd", "GPT_REQUIRED", 0.5, "LOW", 0, 0), (8, "x", "GPT_REQUIRED", 0.5, "LOW", 0, 0), (9, "x", "GPT_WITH_GLOSSARY_REQUIRED", 0.5, "LOW", 0, 0)]
    state = [(0, " New ", None), (1, "confirmed", ""), (2, "tm_prefilled", ""), (3, "new", "done"), (4, None, None), (6, "new", ""), (7, "untranslated", ""), (8, "tm_prefilled", ""), (9, "", "")]  # 5 has none
    tables = {"routed": (ROUTED, routed), "segment_state": (STATE, [(*r, True, False) for r in state])}
    assert sorted(r.id for r in bound(spark, "mt_eligible", **tables)) == [0, 2, 4, 5]
    assert sorted(r.id for r in bound(spark, "gpt_eligible", **tables)) == [7, 9]
    (p,) = bound(spark, "mt_preview", **tables)
    assert (p.eligible, p.batches, p.saved, p.included, p.excluded) == (4, 1, 0.032, "0,2,4", "1:status,3:has_target,6:confidence")
    assert {r.route: (r.tokens, r.usd) for r in bound(spark, "gpt_preview", **tables)} == {"GPT_REQUIRED": (702, 0.0702), "GPT_WITH_GLOSSARY_REQUIRED": (700, 0.07)}


def test_prefill_reads_route_and_state(spark):
    routed = [(1, "One", "EXACT_TM", 1.0, "LOW", 0, 0), (2, "one", "EXACT_TM", 1.0, "HIGH", 0, 0), (3, "one", "EXACT_TM", 1.0, "LOW", 0, 2), (4, "one", "EXACT_TM", 1.0, "LOW", 0, 0), (5, "one", "GPT_REQUIRED", 1.0, "LOW", 0, 0), (6, "two", "EXACT_TM", 1.0, "LOW", 0, 0)]
    tables = {"routed": (ROUTED, routed), "segment_state": (STATE, [(4, "new", "has one", True, False)]), "documents": documents((9, "one"))}
    assert sorted((r.id, r.target_text, r.status) for r in bound(spark, "tm_prefill_batch", **tables)) == [(1, "TM:9", "confirmed"), (2, "TM:9", "tm_prefilled"), (3, "TM:9", "tm_prefilled")]


def test_prices_of_a_run(spark):
    registry._load()
    schema, rows = documents((1, "x" * 400))
    docs = {"documents": spark.createDataFrame(rows, schema)}
    one = lambda **lists: run(spark, "cost_estimate", docs, **lists).first()
    assert (one().translate_usd, one().mt_usd) == (0.0063, 0.01)
    got = one(PRICE_OVERRIDES=(("translate_in", 10), ("mt", 2.5), ("unknown", 1)))
    assert (got.translate_usd, got.mt_usd, got.qa_usd) == (0.0088, 0.001, one().qa_usd)  # (500 * 10 + 256 * 15) / 1e6
