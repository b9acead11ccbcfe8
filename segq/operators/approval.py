"""Approval gates and the review queue."""

from segq.operators.routing import NAMES
from segq.plans.core import relation


@relation("documents", "labels", query=False)
def segment_state(d):
    """Status, target and checks of each segment, one row an id; an application
    binds its own table.  The test tables have none, so labels stand in."""
    status = "CASE WHEN quality = 1 THEN 'translated' WHEN quality = 0 THEN 'new' ELSE 'google_draft' END"
    rated = "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id"
    return f"SELECT s.id, {status} AS status, CASE WHEN quality = 0 THEN '' ELSE 'T:' || s.id END AS target_text, coalesce(quality, 1) = 1 AS qa_passed, coalesce(toxic, 0) = 1 AS hallucination FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL) s LEFT JOIN ({rated}) l ON s.id = l.doc_id"


@relation("upgraded", "segment_state", query=False)
def approval_input(d):
    """Routed segments with their state and the flags of review: one row each.
    A segment without a state is new and without a target."""
    return f"""SELECT s.*, coalesce(t.status, 'new') AS status, coalesce(t.target_text, '') AS target_text, coalesce(t.qa_passed, true) AS qa_passed, coalesce(t.hallucination, false) AS hallucination, {NAMES.format('s.after_depth')} AS depth_name
FROM upgraded s LEFT JOIN segment_state t ON s.id = t.id"""


#: Eleven basic checks, then six never-approve checks, in order: (reason, test).
BASIC = (
    ("not_translated", "status NOT IN ('translated', 'google_draft')"), ("risk_", "level IN ('HIGH', 'CRITICAL')"), ("empty_target", "trim(source_text) = '' OR trim(target_text) = ''"), ("local_qa_fail", "text_chars < 5"), ("qa_alerts", "depth_name = 'critical_full_review' AND n_forbidden_post = 0"),
    ("forbidden_alert", "n_forbidden_post > 0"), ("numerical_mismatch", "n_numbers > 20 AND n_units > 0"), ("consistency_conflict", "group_id IS NOT NULL AND tm_score < 99 AND NOT is_representative"), ("glossary_conflict", "glossary_matches > 14"),
    ("semantic_alert", "safe_confidence > 0 AND safe_confidence < 95e-2"), ("hallucination_suspicion", "hallucination"),
)
NEVER = (("never_non_low", "level <> 'LOW'"), ("never_table_cell", "block_type = 'table_cell'"), ("never_dosage", "n_units > 0"), ("never_abbreviations", "n_abbr > 0"), ("never_pos_neg", "n_polarity > 0"), ("never_directions", "n_direction > 0"), ("never_lab_values", "n_lab > 0"), ("never_numbers", "n_ranges > 0"))
#: Gates of the routes: (route, reason, test that must hold).
GATES = (
    ("EXACT_TM", "tm_gate", "tm_score >= 99"), ("GOOGLE_SAFE", "mt_gate", "status = 'google_draft' AND intent IN ('metadata_simple', 'author_list', 'institution_simple') AND entity <= 6e-1"),
    ("GPT_REQUIRED", "gpt_gate", "qa_passed AND after_depth < 3"), ("GPT_WITH_GLOSSARY_REQUIRED", "gpt_gate", "qa_passed AND after_depth < 3"),
)


@relation("approval_input")
def approval_gate(d):
    """First failing basic check, else never-approve check, else the route's
    own gate; routes without a gate are never approved."""
    first = "CASE " + " ".join(f"WHEN {test} THEN " + ("'risk_' || lower(level)" if name == "risk_" else f"'{name}'") for name, test in BASIC + NEVER) + " ELSE "
    gate = "CASE route " + " ".join(f"WHEN '{route}' THEN CASE WHEN {test} THEN NULL ELSE '{reason}' END" for route, reason, test in GATES) + " ELSE 'route_not_eligible' END END"
    return f"SELECT id, route, reason IS NULL AS eligible, reason FROM (SELECT id, route, {first}{gate} AS reason FROM approval_input) t"


@relation("approval_gate")
def approval_reasons(d):
    return "SELECT reason, count(*) AS n FROM approval_gate WHERE reason IS NOT NULL GROUP BY reason"


@relation("approval_gate", "approval_reasons")
def approval_examples(d):
    """One example (smallest id) of each of the five commonest reasons."""
    return "SELECT g.reason, min(g.id) AS example_id FROM approval_gate g JOIN (SELECT reason FROM approval_reasons ORDER BY n DESC, reason LIMIT 5) t ON g.reason = t.reason GROUP BY g.reason"


@relation("approval_gate")
def approval_execute(d):
    return "SELECT id, 'confirmed' AS status, 'auto:' || route AS approval_source FROM approval_gate WHERE eligible"


#: Fixed values: (alert, boost, test over ``approval_input``) in the order in
#: which alerts are raised; the first one raised is the top alert.
ALERTS = (
    ("qa_failed", 60, "hallucination"), ("qa_warning", 60, "depth_name IN ('full_medical_qa', 'full_medical_qa_backcheck')"), ("google_needs_review", 50, "status = 'google_draft' AND route <> 'GOOGLE_SAFE'"),
    ("entity_corruption", 85, "entity > 9e-1"), ("name_corruption", 85, "n_initials > 2"), ("semantic_drift", 85, "safe_confidence < 2e-1"), ("consistency_conflict", 65, "group_id IS NOT NULL AND tm_score < 99 AND NOT is_representative"),
    ("numeric_mismatch", 90, "n_numbers > 3"), ("glossary_conflict", 70, "glossary_matches > 14"), ("forbidden_detected", 95, "n_forbidden_post > 0"), ("backcheck_low", 40, "depth_name = 'full_medical_qa_backcheck' AND safe_confidence < 4e-1"), ("risk_level", 30, "level IN ('HIGH', 'CRITICAL')"),
)
BOOST = "CASE {} " + " ".join(f"WHEN '{name}' THEN {boost}" for name, boost, _ in ALERTS) + " ELSE 30 END"
#: Nine rules, first match wins, the last one always holds.
ACTIONS = (
    ("level = 'CRITICAL'", "expert_review"), ("contains(alerts, 'forbidden_detected')", "replace_forbidden_term"), ("contains(alerts, 'backcheck_low')", "repeat_back_check"), ("contains(alerts, 'numeric_mismatch')", "check_numbers"), ("contains(alerts, 'consistency_conflict')", "align_with_group"),
    ("contains(alerts, 'qa_warning')", "edit_and_repeat_qa"), ("contains(alerts, 'google_needs_review')", "review_machine_draft"), ("level = 'HIGH'", "review_with_care"), ("true", "edit_and_confirm"),
)


@relation("approval_input", query=False)
def review_rows(d):
    """Segments in review and their alerts in one array, in the order in which
    they are raised, so nothing is joined back."""
    return f"""SELECT i.id, i.route, i.level, i.status, i.source_text, {d.flags(*((name, test) for name, _, test in ALERTS))} AS found FROM approval_input i WHERE i.status IN ('translated', 'google_draft')"""


@relation("review_rows", query=False)
def review_alerts(d):
    return f"SELECT id, alert, {BOOST.format('alert')} AS boost FROM (SELECT id, {d.explode('found')} AS alert FROM review_rows) a"


@relation("review_rows")
def review_queue(d):
    """Priority (the highest boost of an alert), top alert (the first raised)
    and suggested action."""
    base = "CASE level WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 80 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 20 ELSE 50 END"
    action = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in ACTIONS) + " END"
    return f"""SELECT id, route, level, status, alerts, top_alert, boost + {base} + CASE WHEN status = 'google_draft' THEN 10 ELSE 0 END AS priority, preview, {action} AS action
FROM (SELECT id, route, level, status, {d.join(d.sort('found'), ',')} AS alerts, {d.item('found', 1)} AS top_alert, {d.most(d.map('found', BOOST.format('x')))} AS boost, substring(source_text, 1, 100) AS preview FROM review_rows WHERE {d.size('found')} > 0) q"""


@relation("review_queue")
def review_filters(d):
    return "SELECT id, priority FROM review_queue WHERE contains(alerts, 'qa_warning') AND level IN ('HIGH', 'MEDIUM') AND status = 'translated'"


@relation("review_queue")
def review_page(d):
    return "SELECT id, priority, top_alert FROM review_queue ORDER BY priority DESC, id LIMIT 20"


@relation("review_queue", "review_alerts", "review_rows")
def review_stats(d):
    """Rows of the queue by level, status and alert; a segment's alerts count
    once for each of its rows."""
    if d.name == "spark":  # one pass over the rows instead of one a kind
        each = "transform(rows, r -> array(struct('level' AS kind, r.level AS name, 1L AS n), struct('status' AS kind, r.status AS name, 1L AS n), struct('total' AS kind, 'total' AS name, 1L AS n)))"
        alerts = "transform(rows, r -> transform(r.found, x -> struct('alert' AS kind, x AS name, m AS n)))"
        by_id = "SELECT id, count(*) AS m, collect_list(struct(level, status, found)) AS rows FROM review_rows WHERE size(found) > 0 GROUP BY id"
        return f"SELECT kind, name, sum(n) AS n FROM (SELECT c.kind, c.name, c.n FROM (SELECT explode(flatten(concat({each}, {alerts}))) AS c FROM ({by_id}) g) e UNION ALL SELECT 'total', 'total', 0L) u GROUP BY kind, name"
    return "SELECT 'level' AS kind, level AS name, count(*) AS n FROM review_queue GROUP BY level UNION ALL SELECT 'status', status, count(*) FROM review_queue GROUP BY status UNION ALL SELECT 'alert', a.alert, count(*) FROM review_queue q JOIN review_alerts a ON q.id = a.id GROUP BY a.alert UNION ALL SELECT 'total', 'total', count(*) FROM review_queue"


#: Statuses that a machine may still translate.
MT_STATUS, GPT_STATUS = ("new", "untranslated", "tm_prefilled", ""), ("new", "untranslated", "")


def open_for(statuses) -> str:
    """First condition of a batch that a segment fails on, of those on its state."""
    return f"WHEN lower(trim(coalesce(t.status, ''))) NOT IN ({', '.join(map(repr, statuses))}) THEN 'status' WHEN coalesce(t.target_text, '') <> '' THEN 'has_target'"


@relation("routed", "segment_state", query=False)
def mt_candidates(d):
    """Segments of the machine route, and why one is in no batch."""
    rows = f"SELECT r.id, r.route, length(r.source_text) AS n_chars, CASE {open_for(MT_STATUS)} WHEN r.safe_confidence < 98e-2 THEN 'confidence' END AS reason FROM routed r LEFT JOIN segment_state t ON r.id = t.id"
    return f"SELECT id, n_chars, reason FROM ({d.settled(rows)}) c WHERE route = 'GOOGLE_SAFE'"


@relation("mt_candidates")
def mt_eligible(d):
    return "SELECT id FROM mt_candidates WHERE reason IS NULL"


@relation("mt_candidates")
def mt_preview(d):
    """A batch before it runs: batches of fifty, cost and saving, three
    segments in it and three left out, with their reasons."""
    three = lambda test, shown: f"SELECT {d.joined('v')} FROM (SELECT {shown} AS v FROM mt_candidates WHERE {test} ORDER BY id LIMIT 3) x"
    inside, outside = three("reason IS NULL", "'' || id"), three("reason IS NOT NULL", "id || ':' || reason")
    return f"SELECT count(*) AS eligible, CAST(ceil(count(*) / 5e1) AS BIGINT) AS batches, round(coalesce(sum(n_chars), 0) / 1e6 * 20, 4) AS usd, round(count(*) * 8e-3, 3) AS saved, ({inside}) AS included, ({outside}) AS excluded FROM mt_candidates WHERE reason IS NULL"


@relation("routed", "segment_state", query=False)
def gpt_candidates(d):
    rows = f"SELECT r.id, r.route, length(r.source_text) AS n_chars, CASE {open_for(GPT_STATUS)} END AS reason FROM routed r LEFT JOIN segment_state t ON r.id = t.id"
    return f"SELECT id, route, n_chars, reason FROM ({d.settled(rows)}) c WHERE route IN ('GPT_REQUIRED', 'GPT_WITH_GLOSSARY_REQUIRED')"


@relation("gpt_candidates")
def gpt_eligible(d):
    return "SELECT id, route FROM gpt_candidates WHERE reason IS NULL"


@relation("gpt_candidates")
def gpt_preview(d):
    """Each route's batch before it runs: batches of ten, tokens and cost."""
    return "SELECT route, eligible, batches, tokens, round(tokens * 1e-4, 4) AS usd FROM (SELECT route, count(*) AS eligible, CAST(ceil(count(*) / 1e1) AS BIGINT) AS batches, CAST(floor(count(*) * (avg(n_chars) / 4 * 23e-1 + 700)) AS BIGINT) AS tokens FROM gpt_candidates WHERE reason IS NULL GROUP BY route) g"


@relation("routed", "segment_state", "memory")
def tm_prefill_batch(d):
    """Segments of the memory's route without a target take the memory's, at no
    cost; those of low risk without forbidden words and numbers are confirmed."""
    rows = f"SELECT r.id, r.route, r.level, r.n_forbidden_post, r.n_numbers, coalesce(t.target_text, '') AS own_target, {d.sha(d.norm('r.source_text'))} AS h FROM routed r LEFT JOIN segment_state t ON r.id = t.id"
    return f"""SELECT r.id, m.target_text, 'TM' AS provider, CASE WHEN r.level = 'LOW' AND r.n_forbidden_post = 0 AND r.n_numbers = 0 THEN 'confirmed' ELSE 'tm_prefilled' END AS status, 100 AS score, 0e0 AS usd, 8e-3 AS saving
FROM ({d.settled(rows)}) r JOIN memory m ON r.h = m.source_hash WHERE r.route = 'EXACT_TM' AND r.own_target = ''"""
