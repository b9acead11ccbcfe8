"""Preflight report and write-back, explanations and recommendations."""

from segq.operators.cost import costs, estimates, optimised, token_columns
from segq.plans.core import relation


@relation("routed", query=False)
def report_cells(d):
    """Totals and histograms in one pass: one row a (kind, name)."""
    groups = "GROUPING SETS ((), (route), (level), (intent))"
    kind = "CASE WHEN grouping(route) = 0 THEN 'route' WHEN grouping(level) = 0 THEN 'level' WHEN grouping(intent) = 0 THEN 'intent' ELSE 'total' END"
    return f"SELECT {kind} AS kind, coalesce(route, level, intent, 'all') AS name, count(*) AS n, count_if(tm_score >= 99) AS memory_99, count_if(glossary_matches > 0) AS covered, count_if(group_id IS NULL OR is_representative) AS distinct_texts, sum(n_words) AS words, sum(text_chars) AS chars FROM routed GROUP BY {groups}"


@relation("report_cells")
def preflight_report(d):
    return "SELECT kind, name, n, memory_99, covered, distinct_texts, words, chars, round(100 * covered / (n * 1e0), 1) AS coverage_percent, round(100 * n / (max(n) OVER () * 1e0), 1) AS percent FROM report_cells"


@relation("routed", "routed_cost")
def preflight_write_back(d):
    """All preflight columns of a segment, in one rewrite of the table."""
    if d.name == "spark":  # costs are columns of the routed row; rows of one id meet as in a join
        own = "id, route, level, score, reasons, intent, density, medicality, entity, reversibility, criticality, safe_confidence, group_id, is_representative, depth"
        priced = f"SELECT *, {costs()} FROM (SELECT *, {estimates()} FROM ({token_columns(d, 'SELECT * FROM routed')}) t) e"
        by_id = f"SELECT id AS one, collect_list(struct({own})) AS rows, collect_list(struct(total_tokens, optimised)) AS prices FROM (SELECT {own}, total_tokens, {optimised()} AS optimised FROM ({priced}) r) p GROUP BY id"
        return f"SELECT {', '.join('r.' + c for c in own.split(', '))}, c.total_tokens, round(c.optimised, 4) AS usd, 'analyzed' AS preflight_status FROM (SELECT r, explode(prices) AS c FROM (SELECT explode(rows) AS r, prices FROM ({by_id}) g) a) b"
    return "SELECT r.id, r.route, r.level, r.score, r.reasons, r.intent, r.density, r.medicality, r.entity, r.reversibility, r.criticality, r.safe_confidence, r.group_id, r.is_representative, r.depth, c.total_tokens, round(c.optimised, 4) AS usd, 'analyzed' AS preflight_status FROM routed r JOIN routed_cost c ON r.id = c.id"


@relation("routed")
def zero_cost_summary(d):
    return "SELECT count_if(route = 'EXACT_TM') AS exact_tm, count_if(route = 'DUPLICATE_PROPAGATION_PENDING') AS propagated, count_if(route = 'GOOGLE_SAFE') AS mt, count_if(route IN ('EXACT_TM', 'DUPLICATE_PROPAGATION_PENDING')) AS free_of_cost, count(DISTINCT group_id) AS groups FROM routed"


EXPLAIN = {
    "EXACT_TM": "the memory holds this text", "DUPLICATE_REPRESENTATIVE": "first of a group of equal texts", "DUPLICATE_PROPAGATION_PENDING": "takes the translation of its group", "GOOGLE_SAFE": "plain text that machine translation renders well",
    "GPT_REQUIRED": "needs a language model", "GPT_WITH_GLOSSARY_REQUIRED": "needs a language model and approved terms", "HUMAN_REVIEW_REQUIRED": "needs a person",
}


@relation("routed")
def route_explanation(d):
    texts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPLAIN.items())
    return f"SELECT id, route, CASE route {texts} ELSE 'unknown route' END AS explanation FROM routed"


@relation("upgraded")
def backcheck_plan(d):
    return "SELECT id, after_depth AS depth, after_depth >= 3 OR criticality >= 7e-1 AS needs_back_check, CASE WHEN level = 'CRITICAL' THEN 'before' ELSE 'after' END AS timing FROM upgraded WHERE after_depth >= 3 OR criticality >= 7e-1"


@relation("risked")
def workflow_recommendation(d):
    """Steps by level alone; abbreviations add one to HIGH."""
    steps = {"LOW": "translate > local_qa", "MEDIUM": "translate > local_qa > light_qa", "HIGH": "translate > local_qa > full_qa > back_check", "CRITICAL": "translate > local_qa > full_qa > back_check > safety > human_review"}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in steps.items())
    return f"SELECT id, level, CASE level {cases} END || CASE WHEN level = 'HIGH' AND n_abbr > 0 THEN ' > abbreviation_check' ELSE '' END AS steps, level IN ('HIGH', 'CRITICAL') AS needs_person FROM risked"


@relation("forbidden")
def severity_of_reason(d):
    return f"SELECT pos, CASE WHEN {d.has('lower(reason)', 'dangerous|critical|opposite')} THEN 'critical' WHEN {d.has('lower(reason)', 'generic|single')} THEN 'warning' ELSE 'info' END AS severity FROM forbidden"


@relation("documents", "conversations", "labels", "part")
def source_profile(d):
    """Row counts and distinct values of each source."""
    one = lambda name, key, value: f"SELECT '{name}' AS source, count(*) AS n, count(DISTINCT {key}) AS keys, count(DISTINCT {value}) AS distinct_values, count(*) - count({value}) AS nulls FROM {name}"
    return " UNION ALL ".join((one("documents", "doc_id", "lang"), one("conversations", "conv_id", "role"), one("labels", "doc_id", "quality"), one("part", "p_partkey", "p_type")))
