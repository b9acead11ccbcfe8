"""Local, numeric and meaning checks over source/target pairs."""

from segq.functions import lexicons as L
from segq.operators.similarity_join import phrase_pairs
from segq.plans.core import relation


@relation("pairs", query=False)
def pair_features(d):
    nums = lambda c: d.all(c, "[0-9]+([.,][0-9]+)?")
    unit = "[0-9] ?(" + "|".join(L.UNITS) + ")"
    cols = []
    for side in ("source", "target"):
        t = f"{side}_text"
        low = f"lower({t})"
        cols += [f"{d.n(low, unit)} AS {side}_dosages", f"{d.n(low, '[0-9] ?(mmol|mg|g|iu|u|mcg)/(l|dl|ml)')} AS {side}_labs", f"{d.all(t, '[0-9]+([.,][0-9]+)? ?%')} AS {side}_percent_list", f"{d.all(t, '[0-9]+[.][0-9]+')} AS {side}_decimal_list"]
        cols += [f"{d.distinct(d.all(t, '[0-9]+'))} AS {side}_digits", f"{d.sort(nums(t))} AS {side}_numbers", f"{d.distinct(d.all(f'lower({t})', unit))} AS {side}_units", f"{d.n(t, '[0-9]+([.,][0-9]+)? ?%')} AS {side}_percents", f"{d.n(t, '[0-9]+ ?[-–] ?[0-9]+')} AS {side}_ranges", f"{d.n(t, '[<>≤≥]')} AS {side}_inequalities", f"{d.n(t, '[0-9]+[.][0-9]+')} AS {side}_decimals", f"{d.n(t, '[(]')} + {d.n(t, '[[]'.replace('[[]', chr(92) + '['))} AS {side}_brackets", f"{d.size(d.distinct(d.all(t, '[A-Z][a-z]{2,}')))} AS {side}_names", f"{d.tokens(t)} AS {side}_tokens"]
    return f"SELECT id, project, source_text, target_text, {', '.join(cols)} FROM pairs"


def _alert_rows(d, source: str, checks) -> str:
    """One row per failed check (long form of the alert array), in one pass."""
    found = d.flags(*((f"{kind}|{severity}", test) for kind, severity, test in checks))
    return f"SELECT id, split_part(x, '|', 1) AS type, split_part(x, '|', 2) AS severity FROM (SELECT id, {d.explode(found)} AS x FROM {source}) t"


@relation("pair_features")
def local_qa_alerts(d):
    common = " + ".join(f"CASE WHEN contains(' ' || lower(target_text) || ' ', ' {w} ') THEN 1 ELSE 0 END" for w in L.COMMON_EN)
    lost = " OR ".join(f"(contains(source_text, '{a}') AND NOT contains(target_text, '{a}'))" for a in L.ABBREVIATIONS)
    ratio = "length(trim(target_text)) / (length(trim(source_text)) * 1e0)"
    return _alert_rows(d, "pair_features", (
        ("empty_output", "error", "length(trim(target_text)) < 1"), ("language", "warning", f"{d.size(d.words('target_text'))} > 5 AND ({common}) < 2"),
        ("length_ratio", "warning", f"CASE WHEN length(trim(source_text)) >= 5 THEN {ratio} < 5e-1 OR {ratio} > 2e0 ELSE false END"), ("numbers_lost", "error", f"{d.size(d.minus('source_digits', 'target_digits'))} > 0"),
        ("abbreviations_lost", "warning", lost), ("names_lost", "info", "source_names > 2 AND target_names < greatest(1, source_names / 2e0)"), ("brackets_lost", "warning", "source_brackets > 0 AND target_brackets < source_brackets / 2e0"),
        ("forbidden_term", "critical", " OR ".join(d.has_item("target_tokens", f"'{bad}'") for _, bad, _ in L.FORBIDDEN)),
    ))


@relation("pair_features")
def numeric_qa_alerts(d):
    same = lambda kind, c: (kind, "error", f"source_{c} <> target_{c}")
    value = lambda x: f"CAST(replace({d.sub(x, '[ %]', '')}, ',', '.') AS DOUBLE)"
    places = lambda x: f"length(split_part({x}, '.', 2))"
    return _alert_rows(d, "pair_features", (
        same("dosage", "dosages"), same("lab_value", "labs"), ("percent_value", "error", f"source_percents = target_percents AND {d.differ('source_percent_list', 'target_percent_list', lambda x, y: f'abs({value(x)} - {value(y)}) > 1e-1')}"),
        ("decimal_places", "warning", f"source_decimals = target_decimals AND {d.differ('source_decimal_list', 'target_decimal_list', lambda x, y: f'{places(x)} <> {places(y)}')}"),
        ("unit_missing", "error", f"{d.size(d.minus('source_units', 'target_units'))} > 0"), ("unit_unexpected", "warning", f"{d.size(d.minus('target_units', 'source_units'))} > 0"), same("percent", "percents"), same("range", "ranges"), same("inequality", "inequalities"), ("decimal", "warning", "source_decimals <> target_decimals"),
        ("numbers_multiset", "error", f"{d.join('source_numbers', ' ')} <> {d.join('target_numbers', ' ')}"),
    ))


@relation("pair_features")
def medical_issues(d):
    has = lambda side, words: " OR ".join(d.has_item(f"{side}_tokens", repr(w)) for w in words)
    rules = [("number_mismatch", "critical", f"{d.join('source_numbers', ' ')} <> {d.join('target_numbers', ' ')}"), ("unit_lost", "major", f"{d.size(d.minus('source_units', 'target_units'))} > 0"), ("negation", "critical", f"({has('source', L.NEGATION)}) AND NOT ({has('target', L.NEGATION)})")]
    for src, want, opposite in L.PAIRS:
        lacks = f"{d.has_item('source_tokens', repr(src))} AND NOT {d.has_item('target_tokens', repr(want))}"
        rules.append((f"pair_{src}", "critical", f"{lacks} AND {d.has_item('target_tokens', repr(opposite))}"))
        rules.append((f"pair_{src}", "major", f"{lacks} AND NOT {d.has_item('target_tokens', repr(opposite))}"))
    rules += [(f"style_{i}", "minor", f"contains(lower(target_text), '{bad}')") for i, (bad, _) in enumerate(L.STYLE)]
    return _alert_rows(d, "pair_features", rules)


@relation("medical_issues", "pairs")
def issue_risk(d):
    points = "CASE severity WHEN 'critical' THEN 50 WHEN 'major' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END"
    meaning = f"type IN ('number_mismatch', 'negation') OR {d.starts('type', "'pair_'")}"
    return f"""SELECT p.id, least(100, coalesce(s, 0)) AS risk, CASE WHEN coalesce(n, 0) = 0 THEN 'green' WHEN forced THEN 'red' WHEN n = style THEN 'yellow' WHEN s >= 50 THEN 'red' WHEN s >= 20 THEN 'yellow' ELSE 'green' END AS color
FROM pairs p LEFT JOIN (SELECT id, sum({points}) + CASE WHEN count_if({meaning}) > 0 THEN 30 ELSE 0 END AS s, count(*) AS n, count_if({d.starts('type', "'style'")}) AS style, count_if({meaning} OR type = 'unit_lost' OR severity = 'critical') > 0 AS forced FROM medical_issues GROUP BY id) i ON p.id = i.id"""


@relation("pairs")
def corrected_text(d):
    text = "target_text"
    for bad, put in L.STYLE:
        text = d.sub(text, f"(?i){bad}", put)
    return f"SELECT id, {text} AS corrected FROM pairs WHERE {text} <> target_text"


@relation("pair_features")
def web_qa(d):
    return f"SELECT id, {d.join('source_numbers', ' ')} = {d.join('target_numbers', ' ')} AS numbers_equal, length(target_text) > 3 * length(source_text) AS too_long FROM pair_features"


@relation("pairs", "local_qa_alerts", "numeric_qa_alerts", "issue_risk")
def qa_final(d):
    """Six stages in one plan: local, numeric, depth, back-check, decision."""
    return """SELECT p.id, CASE WHEN coalesce(l.bad, 0) > 0 THEN 'fail' WHEN coalesce(l.n, 0) > 0 THEN 'warning' ELSE 'pass' END AS local_status, coalesce(n.bad, 0) = 0 AS numeric_passed, r.color = 'red' OR coalesce(l.n, 0) > 0 AS needs_back_check,
CASE WHEN coalesce(l.bad, 0) > 0 THEN 'qa_failed' WHEN coalesce(l.n, 0) > 0 OR coalesce(n.bad, 0) > 0 THEN 'qa_warning' WHEN r.color = 'red' THEN 'human_review' ELSE 'qa_passed' END AS final_status
FROM pairs p JOIN issue_risk r ON p.id = r.id LEFT JOIN (SELECT id, count(*) AS n, count_if(severity IN ('error', 'critical')) AS bad FROM local_qa_alerts GROUP BY id) l ON p.id = l.id LEFT JOIN (SELECT id, count_if(severity = 'error') AS bad FROM numeric_qa_alerts GROUP BY id) n ON p.id = n.id"""


@relation("qa_final")
def qa_summary(d):
    return "SELECT count(*) AS total, count_if(local_status = 'pass') AS local_pass, count_if(local_status = 'warning') AS local_warning, count_if(local_status = 'fail') AS local_fail, count_if(numeric_passed) AS numeric_pass, count_if(needs_back_check) AS back_checks, count_if(final_status = 'qa_passed') AS passed, count_if(final_status = 'qa_warning') AS warnings, count_if(final_status = 'qa_failed') AS failed, count_if(final_status = 'human_review') AS human FROM qa_final"


@relation("local_qa_alerts", "numeric_qa_alerts", "medical_issues")
def issue_board(d):
    return "SELECT type, severity, count(*) AS n, count(DISTINCT id) AS segments FROM (SELECT * FROM local_qa_alerts UNION ALL SELECT * FROM numeric_qa_alerts UNION ALL SELECT * FROM medical_issues) u GROUP BY type, severity"


@relation("pairs", "glossary_use", "memory")
def context_package(d):
    """What a check of a pair gets: its neighbours in the project, whole, the
    first twenty approved terms of its source, the memory's entry, forbidden
    phrases, and the fixed domain, rules and risks."""
    w = "(PARTITION BY p.project ORDER BY p.turn)"
    terms = f"SELECT id, {d.joined("term || '=' || target", '|')} AS terms FROM (SELECT id, term, target, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS rn FROM glossary_use) g WHERE rn <= 20 GROUP BY id"
    bad = "|".join(f"{x}>{put}" for x, put in L.STYLE)
    return f"""SELECT p.id, p.source_text, coalesce(lag(p.source_text) OVER {w}, '') AS context_before, coalesce(lead(p.source_text) OVER {w}, '') AS context_after, 'medical' AS domain, 'clinical_segment' AS text_type, coalesce(t.terms, '') AS approved_terms, coalesce(m.target_text, '') AS tm_examples, '{bad}' AS forbidden_terms, '{"|".join(L.CHECK_RULES)}' AS style_rules, '{"|".join(L.KNOWN_RISKS)}' AS known_risks
FROM pairs p LEFT JOIN ({terms}) t ON p.id = t.id LEFT JOIN memory m ON {d.sha(d.norm('p.source_text'))} = m.source_hash"""


@relation("pairs", "glossary", query=False)
def glossary_use(d):
    """Approved terms that stand in a pair's source as phrases."""
    held = phrase_pairs(d, "(SELECT term AS id, term AS t FROM glossary WHERE tier = 'approved')", "(SELECT id, source_text AS t FROM pairs)")
    return f"SELECT h.b_id AS id, g.term, split_part(g.target, '; ', 1) AS target FROM ({held}) h JOIN glossary g ON h.a_id = g.term"


@relation("pairs")
def qa_report(d):
    return "SELECT id, substring(source_text, 1, 50) AS source_preview, substring(target_text, 1, 50) AS target_preview, CASE WHEN target_text <> '' THEN 'translated' ELSE 'new' END AS status FROM pairs WHERE target_text <> ''"
