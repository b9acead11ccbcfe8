"""Routing, policies, workflow and QA depth."""

from segq.operators.scoring import INTENT
from segq.plans.core import BLOCK, dense, relation

DEPTH = """CASE WHEN level = 'CRITICAL' THEN 4 WHEN level = 'HIGH' THEN 3 WHEN route IN ('EXACT_TM', 'DUPLICATE_PROPAGATION_PENDING', 'GOOGLE_SAFE') THEN 0 WHEN route = 'GPT_REQUIRED' THEN CASE WHEN level = 'MEDIUM' THEN 1 ELSE 0 END
WHEN route = 'GPT_WITH_GLOSSARY_REQUIRED' THEN CASE WHEN level = 'MEDIUM' THEN 2 ELSE 1 END WHEN route = 'HUMAN_REVIEW_REQUIRED' THEN 4 ELSE 1 END"""
NAMES = "CASE {} WHEN 0 THEN 'local_only' WHEN 1 THEN 'local_plus_light_gpt' WHEN 2 THEN 'full_medical_qa' WHEN 3 THEN 'full_medical_qa_backcheck' ELSE 'critical_full_review' END"


@relation("segments", "memory", query=False)
def context(d):
    """Memory score and duplicate group of each segment."""
    hashed = f"SELECT id, {d.key(d.norm('source_text'))} AS h FROM segments"
    if d.name == "spark":
        hashed += " DISTRIBUTE BY h"  # one exchange serves the rows and their groups
    return f"SELECT s.id, CASE WHEN m.id IS NOT NULL AND m.id <> s.id THEN 100 ELSE 0 END AS tm_score, CASE WHEN g.n > 1 THEN g.first_id END AS group_id, s.id = g.first_id AS is_representative FROM ({hashed}) s JOIN (SELECT h, count(*) AS n, min(id) AS first_id FROM ({hashed}) x GROUP BY h) g ON s.h = g.h LEFT JOIN memory m ON s.h = m.source_hash"


@relation("scored", "context", "term_counts", query=False)
def routed(d):
    """Route, level and depth of each segment with what the later steps read,
    all in one row: eleven ordered rules to seven routes (fixed thresholds)."""
    return f"""SELECT r.*, {DEPTH} AS depth FROM (SELECT t.*, CASE WHEN tm_score >= 99 THEN 'EXACT_TM' WHEN group_id IS NOT NULL AND is_representative THEN 'DUPLICATE_REPRESENTATIVE' WHEN group_id IS NOT NULL THEN 'DUPLICATE_PROPAGATION_PENDING'
WHEN level = 'CRITICAL' THEN 'HUMAN_REVIEW_REQUIRED' WHEN level = 'HIGH' THEN CASE WHEN glossary_matches > 0 OR medicality > 5e-1 THEN 'GPT_WITH_GLOSSARY_REQUIRED' ELSE 'HUMAN_REVIEW_REQUIRED' END
WHEN intent IN ('metadata_simple', 'author_list') THEN CASE WHEN safe_confidence >= 98e-2 THEN 'GOOGLE_SAFE' ELSE 'GPT_REQUIRED' END WHEN intent IN ('biography_or_affiliation', 'institution_complex') THEN 'GPT_REQUIRED'
WHEN intent = 'table_or_numeric' THEN CASE WHEN criticality > 5e-1 THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'GPT_REQUIRED' END WHEN glossary_matches >= 2 OR medicality > 6e-1 THEN 'GPT_WITH_GLOSSARY_REQUIRED' WHEN n_forbidden_pre > 0 THEN 'HUMAN_REVIEW_REQUIRED'
WHEN safe_confidence >= 98e-2 THEN 'GOOGLE_SAFE' ELSE 'GPT_REQUIRED' END AS route
FROM (SELECT x.id, x.segment_order, x.block_type, x.project, x.source_text, x.level, x.score, x.reasons, x.density, x.medicality, x.entity, x.reversibility, x.criticality, x.safe_confidence, x.n_forbidden_pre, x.n_forbidden_post, x.n_direction, x.n_words, x.n_numbers, x.n_abbr, x.n_polarity, x.n_initials, x.n_units, x.n_ranges, x.n_lab, {INTENT} AS intent, length(x.source_text) AS text_chars, c.tm_score, c.group_id, c.is_representative, coalesce(g.n, 0) AS glossary_matches
FROM scored x JOIN context c ON x.id = c.id LEFT JOIN term_counts g ON x.id = g.id) t) r"""


@relation("routed")
def route_decision(d):
    """The route with the policies of the level."""
    return """SELECT id, route, level, CASE level WHEN 'CRITICAL' THEN 'strict' WHEN 'HIGH' THEN 'strict' WHEN 'MEDIUM' THEN 'manual' ELSE 'auto_pass' END AS qa_policy, CASE level WHEN 'CRITICAL' THEN 'dual' WHEN 'HIGH' THEN 'single' WHEN 'MEDIUM' THEN 'single' ELSE 'automated' END AS approval_policy,
glossary_matches, safe_confidence, text_chars AS n_chars FROM routed"""


@relation("routed")
def route_simple(d):
    """The alternative six-rule router."""
    return """SELECT id, CASE WHEN route IN ('EXACT_TM', 'DUPLICATE_PROPAGATION_PENDING') THEN route WHEN level IN ('CRITICAL', 'HIGH') THEN 'HUMAN_REVIEW_REQUIRED' WHEN glossary_matches >= 3 THEN 'GPT_WITH_GLOSSARY_REQUIRED' WHEN level = 'LOW' AND n_direction = 0 AND safe_confidence >= 98e-2 THEN 'GOOGLE_SAFE' ELSE 'GPT_REQUIRED' END AS route FROM routed"""


@relation("risk_score")
def policy_bands(d):
    """The policy's own bands, 75/50/25."""
    return "SELECT id, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM risk_score"


@relation("route_decision")
def route_histogram(d):
    return "SELECT coalesce(route, 'unknown') AS route, count(*) AS n, round(100 * count(*) / (sum(count(*)) OVER () * 1e0), 1) AS percent FROM route_decision GROUP BY coalesce(route, 'unknown')"


PRIORITY = "CASE route WHEN 'EXACT_TM' THEN 0 WHEN 'DUPLICATE_PROPAGATION_PENDING' THEN 1 WHEN 'GOOGLE_SAFE' THEN 2 WHEN 'DUPLICATE_REPRESENTATIVE' THEN 3 WHEN 'GPT_REQUIRED' THEN 4 WHEN 'GPT_WITH_GLOSSARY_REQUIRED' THEN 5 WHEN 'HUMAN_REVIEW_REQUIRED' THEN 6 ELSE 99 END"


def dense_once(rows: str) -> str:
    """``dense`` of (id, route, priority, block), none of them null: the blocks
    are counted and numbered from one exchange, so routes are evaluated once.
    The last condition always holds; it keeps the columns of both sides alike."""
    dealt = f"SELECT id, route, priority, block FROM ({rows}) r DISTRIBUTE BY priority, block"
    sizes = f"SELECT priority, block, count(*) AS size FROM ({dealt}) s GROUP BY priority, block HAVING max(length(route)) >= 0 AND max(id) IS NOT NULL"
    offsets = f"SELECT priority, block, sum(size) OVER (ORDER BY priority, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM ({sizes}) z"
    return f"SELECT b.id, b.route, b.priority, CAST(o.ahead + row_number() OVER (PARTITION BY b.priority, b.block ORDER BY b.id) AS BIGINT) AS place FROM ({dealt}) b JOIN ({offsets}) o ON b.priority = o.priority AND b.block = o.block"


@relation("route_decision")
def batch_order(d):
    """Priority of each route, and the place of the segment in the whole order
    (numbered block by block, so no task sorts a route)."""
    if d.name == "spark":
        return dense_once(f"SELECT id, route, {PRIORITY} AS priority, coalesce(CAST(floor(id / {BLOCK}e0) AS BIGINT), -1) AS block FROM route_decision")
    numbered = dense(f"(SELECT id, route, {PRIORITY} AS priority FROM route_decision)", "id", "priority")
    return f"SELECT id, route, priority, place FROM ({numbered}) n"


@relation("route_decision")
def web_batch_top10(d):
    return f"SELECT id, route FROM route_decision WHERE route IN ('EXACT_TM', 'GOOGLE_SAFE', 'GPT_REQUIRED') ORDER BY {PRIORITY}, id LIMIT 10"


@relation("route_decision")
def workflow_steps(d):
    step = lambda test, name: f"CASE WHEN {test} THEN '{name}' END"
    gpt = "route IN ('GPT_REQUIRED', 'GPT_WITH_GLOSSARY_REQUIRED', 'DUPLICATE_REPRESENTATIVE', 'HUMAN_REVIEW_REQUIRED')"
    steps = d.array(step("route = 'EXACT_TM'", "tm_lookup"), step("route = 'DUPLICATE_PROPAGATION_PENDING'", "propagate"), step("route = 'GOOGLE_SAFE'", "mt_translate"), step(gpt, "translate"), step(f"{gpt} AND level <> 'LOW'", "qa"), step(f"{gpt} AND level IN ('HIGH', 'CRITICAL')", "back_check"), step(f"{gpt} AND level = 'CRITICAL'", "safety"), step("route = 'HUMAN_REVIEW_REQUIRED'", "human_review"))
    kept = d.filter(steps, "x IS NOT NULL")
    return f"SELECT id, {d.join(kept, ' > ')} AS steps, {d.size(kept)} AS n_steps, level IN ('HIGH', 'CRITICAL') AS requires_human FROM route_decision"


TOKENS = "CASE depth WHEN 0 THEN 0 WHEN 1 THEN 800 WHEN 2 THEN 1200 ELSE CAST(floor(text_chars / 4e0 + 1500) AS INT) END"


@relation("routed")
def qa_depth(d):
    return f"SELECT id, {NAMES.format('depth')} AS qa_depth, {TOKENS} AS qa_tokens, round({TOKENS} * 1e-4, 4) AS qa_usd FROM routed"


#: (reason, test over ``routed``, least depth): upgrades never go down.
UPGRADES = (
    ("forbidden_term_detected", "n_forbidden_post > 0", 4), ("critical_anomaly", "criticality > 95e-2", 4), ("entity_corruption", "entity > 9e-1", 4),
    ("consistency_conflict", "group_id IS NOT NULL AND tm_score < 99 AND NOT is_representative", 3), ("glossary_conflict", "glossary_matches > 14", 3), ("semantic_uncertainty", "safe_confidence < 5e-1", 3), ("numerical_mismatch", "n_numbers > 20 AND n_units > 0", 3),
    ("local_qa_warning", "n_words > 0 AND text_chars < 5", 2), ("light_gpt_issue", "reversibility > 6e-1", 2),
)


@relation("routed", query=False)
def upgraded(d):
    up = ", ".join(f"CASE WHEN {test} THEN {depth} ELSE 0 END" for _, test, depth in UPGRADES)
    return f"SELECT r.*, greatest(depth, {up}) AS after_depth, {d.flags(*((name, test) for name, test, _ in UPGRADES))} AS upgrade_reasons FROM routed r"


@relation("upgraded")
def qa_depth_upgrade(d):
    """Upgrades by eight reasons (and one more for numbers), never down."""
    return f"SELECT id, {NAMES.format('depth')} AS before, {NAMES.format('after_depth')} AS after, {d.join('upgrade_reasons', ',')} AS reasons FROM upgraded"
