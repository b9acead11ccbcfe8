"""Issues of source/target pairs by rules that are tables of any size.

``pair_rules`` (pos, rule, type, label, kind, phrase), ``style_rules`` (bad,
preferred, source_phrase, type, severity, explanation), ``negations`` (side,
phrase) and ``meaning_verdicts`` (id, equivalent) may be bound to tables; the
defaults are word lists.  All phrases of a side are looked up in one phrase
join, then rules are judged in one aggregate by pair and rule.  Null texts are
empty, rules without a phrase never apply, and phrases are matched whole, case
folded, over any white space.
"""

from segq.functions import lexicons as L
from segq.operators.similarity_join import contained_pairs, phrase_pairs
from segq.plans.core import relation


def _values(columns: str, rows, empty: str) -> str:
    """SELECT of literal rows; ``empty`` are typed nulls for no rows at all."""
    if not rows:
        return f"SELECT {empty} WHERE false"
    shown = lambda v: str(v) if isinstance(v, int) else "'" + v + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS v({columns})"


@relation(query=False)
def pair_rules(d):
    """A source phrase of a rule asks for one of its expected phrases in the
    target; without it, one of its opposites makes the issue critical."""
    rows = [(name, kind, label, side, phrase) for name, kind, label, *sides in L.PAIR_RULES for side, phrases in zip(("source", "expected", "opposite"), sides) for phrase in phrases]
    text = "CAST(NULL AS STRING)"
    return _values("pos, rule, type, label, kind, phrase", [(i, *r) for i, r in enumerate(rows)], f"0 AS pos, {text} AS rule, {text} AS type, {text} AS label, {text} AS kind, {text} AS phrase")


@relation(query=False)
def style_rules(d):
    text = "CAST(NULL AS STRING)"
    return _values("bad, preferred, source_phrase, type, severity, explanation", L.STYLE_RULES, ", ".join(f"{text} AS {c}" for c in ("bad", "preferred", "source_phrase", "type", "severity", "explanation")))


@relation(query=False)
def negations(d):
    rows = [(side, phrase) for side, phrases in (("source", L.NEGATION_SOURCE), ("target", L.NEGATION_TARGET)) for phrase in phrases]
    return _values("side, phrase", rows, "CAST(NULL AS STRING) AS side, CAST(NULL AS STRING) AS phrase")


@relation(query=False)
def meaning_verdicts(d):
    """Pairs whose meaning a model has judged; those it hasn't are equivalent."""
    return "SELECT CAST(NULL AS STRING) AS id, true AS equivalent WHERE false"


@relation("pair_rules", "negations", query=False)
def rule_phrases(d):
    """Phrases of all rules by the side they are looked for on."""
    return """SELECT DISTINCT CASE WHEN kind = 'source' THEN 'source' ELSE 'target' END AS side, lower(phrase) AS phrase, rule, kind FROM pair_rules WHERE rule IS NOT NULL AND phrase IS NOT NULL
UNION ALL SELECT DISTINCT side, lower(phrase) AS phrase, '' AS rule, CASE WHEN side = 'source' THEN 'source' ELSE 'expected' END AS kind FROM negations WHERE phrase IS NOT NULL"""


@relation("rule_phrases", "pairs", query=False)
def rules_met(d):
    """For each pair and rule that has a phrase in it: whether the source asks,
    the target answers, or says the opposite.  Negation is the rule ''."""
    asked = lambda side: f"(SELECT DISTINCT phrase AS id, phrase AS t FROM rule_phrases WHERE side = '{side}')"
    held = " UNION ALL ".join(f"SELECT b_id AS id, a_id AS phrase, '{side}' AS side FROM ({phrase_pairs(d, asked(side), f'(SELECT id, {side}_text AS t FROM pairs)')}) {side}_hits" for side in ("source", "target"))
    return f"SELECT h.id, r.rule, bool_or(r.kind = 'source') AS asked, bool_or(r.kind = 'expected') AS met, bool_or(r.kind = 'opposite') AS opposed FROM ({held}) h JOIN rule_phrases r ON h.phrase = r.phrase AND h.side = r.side GROUP BY h.id, r.rule"


@relation("pair_rules", query=False)
def rule_facts(d):
    """Type and label of a rule, two of its source phrases and all expected."""
    numbered = "SELECT *, row_number() OVER (PARTITION BY rule, kind ORDER BY pos, phrase) AS rn FROM pair_rules WHERE phrase IS NOT NULL"
    return f"SELECT rule, min(type) AS type, min(label) AS label, {d.joined_by("CASE WHEN kind = 'source' AND rn <= 2 THEN phrase END", 'pos', ', ')} AS source_fragment, {d.joined_by("CASE WHEN kind = 'expected' THEN phrase END", 'pos', ', ')} AS target_fragment FROM ({numbered}) n GROUP BY rule"


WS = r"[ \t\n\x0b\f\r]*"


def units(d, col: str) -> str:
    """Units that stand behind a number, in order; a percent sign counts where
    a word follows it at once."""
    names = "|".join(u.replace(" ", WS) for u in L.ISSUE_UNITS)
    found = d.all(f"lower({col})", rf"[0-9]+([.,][0-9]+)?{WS}(({names})($|[^\p{{L}}\p{{N}}_])|%[\p{{L}}\p{{N}}_])")
    return d.sort(d.map(found, d.sub(d.sub("x", rf"^[0-9.,]+{WS}", ""), r"(%).*$|[^\p{L}\p{N}_]$", "$1")))


def variants(d, col: str) -> str:
    """Wordings of a target, parted by semicolon, slash, comma or the word or."""
    parted = d.sub(col, rf"{WS}([;/,]| [oO][rR] ){WS}", ";")
    return d.filter(d.split(parted, ";"), f"{d.padded('x')} <> '  '")


@relation("pairs", "rules_met", "rule_facts", "style_rules", "glossary_use", "glossary", query=False)
def issues_found(d):
    none = "''"
    columns = ("id", "type", "severity", "explanation", "source_fragment", "target_fragment", "bad_fragment", "suggested_fragment", "detected_by")
    row = lambda *v: ", ".join(f"{x} AS {c}" for x, c in zip(v, columns))
    check, numbers = "'deterministic_validator'", lambda c: d.sort(d.all(c, "[0-9]+([.,][0-9]+)?"))
    read = f"SELECT id, {numbers('source_text')} AS sn, {numbers('target_text')} AS tn, {units(d, 'source_text')} AS su, {units(d, 'target_text')} AS tu FROM pairs"
    style = contained_pairs(d, "(SELECT DISTINCT lower(bad) AS id, lower(bad) AS t FROM style_rules WHERE bad <> '')", f"(SELECT id, {d.norm('target_text')} AS t FROM pairs)")
    skip = lambda words: ", ".join(map(repr, words))
    judged = f"SELECT u.id, g.term, g.target, p.target_text, {variants(d, 'g.target')} AS ways FROM glossary_use u JOIN glossary g ON u.term = g.term JOIN pairs p ON u.id = p.id WHERE lower(g.term) NOT IN ({skip(L.ISSUE_SKIP_TERMS)})"
    missing = f"{d.size('ways')} > 0 AND {d.size(d.filter('ways', f'lower(trim(x)) IN ({skip(L.ISSUE_SKIP_TARGETS)})'))} = 0 AND {d.size(d.filter('ways', f'contains(target_padded, {d.padded("x")})'))} = 0"
    return f"""SELECT {row('id', "'number_unit_dosage_mismatch'", "'critical'", "'Numbers of source and target differ.'", d.join('sn', ', '), d.join('tn', ', '), none, none, check)} FROM ({read}) n WHERE {d.size('sn')} > 0 AND {d.join('sn', ' ')} <> {d.join('tn', ' ')}
UNION ALL SELECT {row('id', "'unit_mismatch'", "'major'", "'The source has units, the target none.'", d.join('su', ', '), none, none, none, check)} FROM ({read}) m WHERE {d.size('su')} > 0 AND {d.size('tu')} = 0
UNION ALL SELECT {row('id', "'negation_shift'", "'critical'", "'Source and target differ in negation.'", none, none, none, none, check)} FROM rules_met WHERE rule = '' AND asked <> met
UNION ALL SELECT {row('r.id', 'f.type', "CASE WHEN r.opposed THEN 'critical' ELSE 'major' END", "'The target does not keep ' || f.label || ' of ' || r.rule || '.'", 'f.source_fragment', 'f.target_fragment', none, none, check)} FROM rules_met r JOIN rule_facts f ON r.rule = f.rule WHERE r.asked AND NOT r.met
UNION ALL SELECT {row('h.b_id', 's.type', 's.severity', 's.explanation', 's.source_phrase', 's.bad', 's.bad', 's.preferred', "'medical_style_qa'")} FROM ({style}) h JOIN style_rules s ON h.a_id = lower(s.bad)
UNION ALL SELECT {row('id', "'glossary_violation'", "'medium'", "'The approved wording of ' || term || ' is not in the target.'", 'term', none, none, 'target', "'glossary_validator'")} FROM (SELECT id, term, target, ways, {d.padded('target_text')} AS target_padded FROM ({judged}) j) v WHERE {missing}"""


@relation("issues_found")
def qa_issues(d):
    """Issues of eleven fields, by the id of their pair.  The time is the run's,
    a parameter, so that a task that runs again writes the same row."""
    return f"SELECT i.*, 'deterministic' AS engine, 'open' AS status, '{L.RUN_TIME[0]}' AS created_at FROM issues_found i"


#: Types that make a pair red, and types of style alone.
FORCED = ("number_unit_dosage_mismatch", "unit_mismatch", "negation_shift", "laterality_shift", "upper_lower_shift", "inner_outer_shift", "anatomy_shift", "diagnosis_symptom_finding_changed", "uncertainty_changed")
STYLE_ONLY = ("literal_calque", "terminology", "forbidden_term", "weak_collocation", "glossary_violation")


@relation("pairs", "issues_found", "meaning_verdicts")
def qa_issue_risk(d):
    """Risk of every pair, and what may be done with it: red goes to a person,
    yellow may be revised by machine."""
    points = "CASE severity WHEN 'critical' THEN 50 WHEN 'major' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END"
    some = lambda kinds: f"type IN ({', '.join(map(repr, kinds))})"
    found = f"SELECT id, CAST(sum({points}) AS BIGINT) AS s, bool_or({some(FORCED)} OR severity = 'critical') AS forced, bool_and({some(STYLE_ONLY)}) AS style FROM issues_found GROUP BY id"
    verdicts = "SELECT id, bool_and(equivalent) AS equivalent FROM meaning_verdicts GROUP BY id"
    scored = f"SELECT p.id, coalesce(f.s, 0) + CASE WHEN coalesce(e.equivalent, true) THEN 0 ELSE 30 END AS s, coalesce(f.forced, false) AS forced, coalesce(f.style, false) AS style FROM pairs p LEFT JOIN ({found}) f ON p.id = f.id LEFT JOIN ({verdicts}) e ON p.id = e.id"
    color = "CASE WHEN forced THEN 'red' WHEN s >= 50 THEN CASE WHEN style THEN 'yellow' ELSE 'red' END WHEN s >= 20 THEN 'yellow' ELSE 'green' END"
    return f"SELECT id, risk, color, color = 'red' AS human_review_required, color = 'yellow' AS auto_revision_allowed FROM (SELECT id, least(s, 100) AS risk, {color} AS color FROM ({scored}) c) r"


@relation("issues_found")
def ui_issues(d):
    """Issues as the user interface shows them."""
    fragment = "CASE WHEN bad_fragment <> '' THEN bad_fragment WHEN target_fragment <> '' THEN target_fragment ELSE source_fragment END"
    return f"SELECT id, CASE severity WHEN 'critical' THEN 'critical' WHEN 'major' THEN 'high' ELSE 'medium' END AS sev, type, explanation || CASE WHEN fragment <> '' THEN ' Fragment: ' || fragment || '.' ELSE '' END || CASE WHEN suggested_fragment <> '' THEN ' Suggestion: ' || suggested_fragment || '.' ELSE '' END AS msg FROM (SELECT *, {fragment} AS fragment FROM issues_found) i"


@relation("issues_found", "pairs")
def term_candidates(d):
    """Terms for the glossary from issues of wording that have a fragment or a
    suggestion, with the whole source."""
    bad = "CASE WHEN i.bad_fragment <> '' THEN i.bad_fragment ELSE i.target_fragment END"
    return f"""SELECT i.id, i.source_fragment AS source_phrase, {bad} AS bad_en, i.suggested_fragment AS preferred_en, 'medical' AS domain, 4e-1 AS confidence, 1 AS occurrences, p.source_text AS source_excerpt, i.type AS source_issue_type, 'pending' AS status
FROM issues_found i JOIN pairs p ON i.id = p.id WHERE i.type IN ({', '.join(map(repr, STYLE_ONLY))}) AND ({bad} <> '' OR i.suggested_fragment <> '')"""


@relation("qa_issue_risk", "pairs")
def medical_write_back(d):
    """Status and risk of a segment by the color of its issues."""
    return "SELECT p.id, CASE r.color WHEN 'red' THEN 'review' WHEN 'yellow' THEN 'translated' ELSE 'qa' END AS status, CASE r.color WHEN 'red' THEN 'high' WHEN 'yellow' THEN 'medium' ELSE 'low' END AS risk, CASE r.color WHEN 'red' THEN 'human_review' WHEN 'yellow' THEN 'auto_revise' ELSE 'accept_or_random_audit' END AS route FROM pairs p JOIN qa_issue_risk r ON p.id = r.id WHERE trim(p.target_text) <> ''"
