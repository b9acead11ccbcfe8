"""Rules against expected rows written by hand."""

import json

import pytest
from test_whole import PART, bound, documents

from segq.operators import calls, providers
from segq.plans.core import run

TURNS = "conv_id long, turn int, role string, text string"


def pairs(*rows):
    """(source, target) pairs; pair k has the id k:0."""
    return TURNS, [x for k, (a, b) in enumerate(rows) for x in ((k, 0, "user", a), (k, 1, "assistant", b))]


def test_prices_are_rounded_to_four_places(spark):
    got = {r.id: r for r in bound(spark, "cost_estimate", documents=documents((1, "x" * 400), (2, None), (3, "ab" * 647)))}
    assert (got[1].translate_usd, got[1].qa_usd, got[1].mt_usd) == (0.0063, 0.0104, 0.01)  # base 100: (500 * 5 + 256 * 15) / 1e6, (1220 * 5 + 288 * 15) / 1e6
    assert (got[2].translate_usd, got[2].mt_usd, got[2].total_tokens) == (0, 0, 0)
    assert got[3].mt_usd == 0.0324  # 1294 * 25 / 1e6 = 0.03235, half up


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ("take 5 mg now", "nimm 5 mg jetzt", set()),
        ("take 5 mg now", "nimm 5 jetzt", {"dosage", "unit_missing"}),
        ("10% of all", "12% von allen", {"percent_value", "numbers_multiset"}),
        ("10.0% of all", "10.05% von allen", {"decimal_places", "numbers_multiset"}),
        ("10%", "10% 20%", {"percent", "numbers_multiset"}),
        ("1-2 days", "1 Tag", {"range", "numbers_multiset"}),
        ("p < 5", "p 5", {"inequality"}),
        ("1.5 and 2", "1.50 und 2", {"decimal_places", "numbers_multiset"}),
        ("7 mmol/l", "7 mmol", {"lab_value"}),
    ],
)
def test_numeric_checks(spark, source, target, want):
    assert {r.type for r in bound(spark, "numeric_qa_alerts", conversations=pairs((source, target)))} == want


def test_local_checks(spark):
    rows = (("all is well here", ""), ("5 mg", "5 mm"), ("keep (this) [one] (two)", "keep none"), ("Anna Berta Carla here", "nobody"), ("word", "one two three vier fuenf sechs seven"), ("a long enough source text", "idiot text of the house is in"))
    got = {(int(r.id.split(":")[0]), r.type) for r in bound(spark, "local_qa_alerts", conversations=pairs(*rows))}
    assert {(0, "empty_output"), (0, "length_ratio"), (1, "abbreviations_lost"), (2, "brackets_lost"), (3, "names_lost"), (4, "language"), (5, "forbidden_term")} <= got
    assert (1, "numbers_lost") not in got and (5, "language") not in got


def test_names_and_abbreviations_with_two_targets(spark):
    rows = (("see Anna Berta now", "siehe Anna Berta"), ("ask Anna Berta", "frag Berta Anna"), ("an ECG now", "ein EKG"), ("the ECG", "das ECG"))
    tables = {"conversations": pairs(*rows)}
    assert [(r.name, r.n_targets, r.n) for r in bound(spark, "consistency_names", **tables)] == [("Anna Berta", 2, 2)]
    assert [(r.abbreviation, r.n_targets) for r in bound(spark, "consistency_abbrev", **tables)] == [("ECG", 2)]


def test_corrected_text_ignores_case(spark):
    got = bound(spark, "corrected_text", conversations=pairs(("a", "Part Of The whole"), ("b", "clean")))
    assert [(r.id, r.corrected) for r in got] == [("0:0", "Part the whole")]


def test_colors(spark):
    rows = (("5", "6"), ("ok", "to be"), ("x", "y"), ("left side", "right side"))
    assert {int(r.id.split(":")[0]): (r.risk, r.color) for r in bound(spark, "issue_risk", conversations=pairs(*rows))} == {0: (80, "red"), 1: (5, "yellow"), 2: (0, "green"), 3: (80, "red")}


TERMS = {"nation": ("n_nationkey int, n_name string", [(1, "FRANCE")]), "part": (PART, [(1, "ring", "b", "t", 1, 1.0)])}


def test_routes(spark):
    docs = documents((1, "same text of words"), (2, "same text of words"), (3, "x"), (4, "infection with 5 mg dialysis sudden left positive hemoglobin and biopsy drug"))
    got = {r.id: r for r in bound(spark, "route_decision", documents=docs, **TERMS)}
    assert (got[1].route, got[2].route) == ("EXACT_TM", "DUPLICATE_PROPAGATION_PENDING")
    assert (got[3].route, got[3].level, got[3].qa_policy) == ("GOOGLE_SAFE", "LOW", "auto_pass") or got[3].route == "GPT_REQUIRED"
    assert (got[4].route, got[4].level, got[4].approval_policy) == ("HUMAN_REVIEW_REQUIRED", "CRITICAL", "dual")


def test_depth_and_its_price(spark):
    docs = documents((4, "infection with 5 mg dialysis sudden left positive hemoglobin and biopsy drug"))
    r = bound(spark, "qa_depth", documents=docs, **TERMS)[0]
    assert (r.qa_depth, r.qa_tokens, r.qa_usd) == ("critical_full_review", 1519, 0.1519)  # 77 characters / 4 + 1500


def test_approval_and_review(spark):
    labels = ("doc_id long, quality int, toxic int", [(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, 1, 1)])
    docs = documents((1, "plain words of a text"), (2, "other plain words"), (4, "infection with 5 mg dialysis sudden left positive hemoglobin and biopsy drug"), (5, "an idiot in a text"))
    gate = {r.id: r.reason for r in bound(spark, "approval_gate", documents=docs, labels=labels, **TERMS)}
    assert (gate[2], gate[4], gate[5]) == ("not_translated", "risk_critical", "forbidden_alert")
    queue = {r.id: r for r in bound(spark, "review_queue", documents=docs, labels=labels, **TERMS)}
    # The first alert raised is the top one, though another has the higher boost.
    assert (queue[5].top_alert, queue[5].action, queue[5].priority) == ("qa_failed", "replace_forbidden_term", 95 + 20)
    assert 2 not in queue and queue[4].priority >= 100 and queue[4].action == "expert_review"


def test_report_counts_each_cell(spark):
    got = {(r.kind, r.name): r.n for r in bound(spark, "preflight_report", documents=documents((1, "a text"), (2, "a text"), (3, "other words")), **TERMS)}
    assert got["total", "all"] == 3 and got["route", "EXACT_TM"] == 1 and sum(n for (kind, _), n in got.items() if kind == "level") == 3


def test_lists_are_parameters(spark):
    docs = {"documents": spark.createDataFrame([(1, "3 furlongs", "en", "s", 10)], documents()[0])}
    assert run(spark, "risk_score", docs).first().score == 5 and run(spark, "risk_score", docs, UNITS=("furlongs",)).first().score == 35
    with pytest.raises(KeyError):
        run(spark, "risk_score", docs, NO_SUCH_LIST=())


def test_glossary_rules(spark):
    rows = [(1, "red big stone", "rot", "t", 50, 1.0), (2, "(open", "auf", "t", 50, 1.0), (3, "see here", "da", "t", 50, 1.0), (4, "a b c d", "system", "t", 50, 1.0)]
    tables = {"part": (PART, rows)}
    assert {r.pos: r.verdict for r in bound(spark, "pair_validity", **tables)} == {1: "ok", 2: "unbalanced", 3: "short", 4: "single_letters"}
    assert {r.pos: (r.verdict, r.issues) for r in bound(spark, "audit_pairs", **tables)} == {1: ("rejected", "lost_qualifier,short"), 2: ("reference", "short"), 3: ("reference", "short"), 4: ("rejected", "lost_qualifier,generic")}
    assert {r.pos: r.expanded for r in bound(spark, "tilde_expansion", **tables)} == {1: "rot red", 2: "(opens auf", 3: "da see", 4: "as system"}


def test_providers_protect_terms_and_fall_back(spark):
    rows = spark.createDataFrame([(1, "keep Foo here"), (2, "abc"), (3, None), (4, "  ")], "id long, source_text string")
    got = {r.id: (r.target, r.provider) for r in providers.translate(rows, providers.stub, fallback=lambda x: [f"<{t}>" for t in x], protect={"Foo": "Bar"}).collect()}
    assert got == {1: ("KEEP Bar HERE", "main"), 2: ("<abc>", "fallback"), 3: ("", "none"), 4: ("", "none")}


def test_model_answers_fall_back_and_forbidden_words_fail(spark):
    bad = "of the"
    rows = spark.createDataFrame([(1, "a", "fine"), (2, "b", f"One {bad.upper()} other"), (3, None, None), (4, "c", "odd"), (5, "d", "high")], "id long, source_text string, target_text string")

    def model(asked):
        return ["[1" if "Source: c" in q else json.dumps({"overall_score": 130 if "Source: d" in q else 30 if bad.upper() in q else 90, "verdict": "pass"}) if "Source: " in q and "Source:  " not in q else None for q in asked]

    got = {r.id: (r.score, r.verdict, r.forbidden_hits) for r in calls.qa_report(rows, model, (("x", bad, "r"), ("y", "other", "r"))).collect()}
    assert got == {1: (90, "pass", 0), 2: (0, "failed", 2), 3: (50, "warning", 0), 4: (50, "warning", 0), 5: (50, "warning", 0)}
    assert [tuple(r)[1:] for r in calls.back_check(rows.filter("id = 4"), model).collect()] == [("", 50, "warning")]


def test_terms_come_from_batches_of_eight(spark):
    rows = spark.createDataFrame([(7, t, f"s{t}", f"t{t}") for t in range(17)], "project long, turn int, source_text string, target_text string")
    model = lambda asked: [json.dumps({"terms": [{"source_term": str(q.count(" = ")), "target_term": "t", "confidence": 1}]}) for q in asked]
    assert {(r.source_term, r.n) for r in calls.batched_terms(rows, model).collect()} == {("8", 2), ("1", 1)}


def test_hyphens_join_lines_in_twos(spark):
    docs = documents((1, "aaa-\nbbb-\ncccc\nd,\ne"), (2, "soft\u00ad\n  next\nlast-"), (3, "a-\nb-\nc-\nd"))
    got = {}
    for r in sorted(bound(spark, "hyphen_join", documents=docs), key=lambda r: r.pos):
        got.setdefault(r.id, []).append(r.joined)
    assert got == {1: ["aaabbb-", "cccc", "d,", "e"], 2: ["softnext", "last"], 3: ["ab-", "cd"]}


def test_ids_of_pairs_never_meet(spark):
    turns = [(1, 2000, "user", "5 mg"), (1, 2001, "assistant", "6 mg"), (3, 0, "user", "plain"), (3, 1, "assistant", "plain")]
    got = {r.id: r.final_status for r in bound(spark, "qa_final", conversations=(TURNS, turns))}
    assert len(got) == 2 and got["1:0"] == "qa_failed" and got["3:0"] == "qa_passed"


def test_english_check_and_trimmed_lengths(spark):
    rows = (("x" * 20, "a as be one two three"), ("y" * 20, "eins zwei drei vier fuenf sechs"), ("   abc   ", "a very long target text for a short source"), ("ten chars!", "   12345678   "), ("word " * 6, "that on are that on are"))
    got = {(int(r.id.split(":")[0]), r.type) for r in bound(spark, "local_qa_alerts", conversations=pairs(*rows))}
    assert (0, "language") not in got and (1, "language") in got and (4, "language") in got
    assert (2, "length_ratio") not in got and (3, "length_ratio") not in got


def test_context_is_whole_and_has_its_terms(spark):
    long = "the " + "word " * 40
    turns = [(1, 0, "user", long), (1, 1, "assistant", "x"), (1, 2, "user", "of the end"), (1, 3, "assistant", "y")]
    docs = documents((9, "of the end"))
    got = {r.id: r for r in bound(spark, "context_package", conversations=(TURNS, turns), documents=docs, **TERMS)}
    two = got["1:2"]
    assert two.context_before == long and two.context_after == "" and two.tm_examples == "TM:9"
    assert two.approved_terms.split("|")[0].startswith("of the=") and "the=" in got["1:0"].approved_terms


def test_large_lists_of_terms_are_joined_by_key(spark):
    from segq.plans.core import RELATIONS

    docs = documents(*((i, f"text {i} of the word{i * 7} and more word{i}x") for i in range(300)))
    terms = spark.range(60000).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id % 2 = 0 THEN 'word' || id ELSE 'of the word' || id END AS t").union(spark.createDataFrame([("t", "the"), ("m", "more word")], "id string, t string"))
    from segq.operators.similarity_join import contained_pairs, phrase_pairs
    from segq.plans.dialect import SPARK

    terms.createOrReplaceTempView("many_terms")
    spark.createDataFrame(docs[1], docs[0]).selectExpr("doc_id AS id", "text AS t").createOrReplaceTempView("some_docs")
    found = spark.sql(phrase_pairs(SPARK, "many_terms", "some_docs"))
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    want = {(k, i) for i in range(300) for k in ["t", str(i * 7)]}  # 'word<n>' and 'of the word<n>' by parity
    got = {(r.a_id, r.b_id) for r in found.collect()}
    assert got == want
    inside = spark.sql(contained_pairs(SPARK, "many_terms", "some_docs"))
    assert "BroadcastNestedLoopJoin" not in inside._jdf.queryExecution().toString()
    got = {(r.a_id, r.b_id) for r in inside.filter("a_id IN ('t', 'm')").collect()}
    assert got == {(k, i) for i in range(300) for k in "tm"}
    for name in ("glossary_violations", "consistency_term", "forbidden_scan"):
        assert name in RELATIONS
