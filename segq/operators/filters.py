"""Lookups, filters, set operations and samples over segments, terms and
memory."""

from segq.functions import lexicons as L
from segq.operators.similarity_join import phrase_pairs
from segq.plans.core import relation


@relation("segments")
def segment_lookup(d):
    return "SELECT id, project, block_type, length(source_text) AS n_chars FROM segments WHERE id = 7"


@relation("customer")
def project_lookup(d):
    return "SELECT c_custkey AS project, c_name AS title FROM customer WHERE c_custkey = 7"


@relation("segments")
def projects_newest(d):
    """Projects with their newest segment; the place counts from the newest."""
    return "SELECT project, newest, row_number() OVER (ORDER BY newest DESC, project) AS place FROM (SELECT project, max(id) AS newest FROM segments GROUP BY project) p"


PREFLIGHT = "id, route, level, score, reasons, density, medicality, entity, reversibility, criticality, safe_confidence, glossary_matches, tm_score, group_id, is_representative, intent, depth, n_words, text_chars"


@relation("routed")
def segments_preflight(d):
    return f"SELECT {PREFLIGHT} FROM routed"


@relation("routed")
def segment_preflight_one(d):
    return f"SELECT {PREFLIGHT} FROM routed WHERE id = 7"


@relation("routed")
def segments_by_route(d):
    return "SELECT id, level FROM routed WHERE route = 'GPT_REQUIRED'"


@relation("routed")
def segments_by_risk(d):
    return "SELECT id, route FROM routed WHERE level = 'HIGH'"


@relation("dup_assign", "dup_top20")
def dup_group_members(d):
    """Members of the largest group."""
    return "SELECT a.id, a.is_representative FROM dup_assign a JOIN (SELECT representative FROM dup_top20 ORDER BY n DESC, representative LIMIT 1) g ON a.group_id = g.representative"


@relation("glossary", "segments")
def glossary_for_project(d):
    """Approved terms of a project or of none, in order."""
    return "SELECT term, target, row_number() OVER (ORDER BY term) AS place FROM (SELECT term, target, tier, CASE WHEN length(term) > 4 THEN 'src3' END AS project FROM glossary) g WHERE (project = 'src3' OR project IS NULL) AND tier = 'approved'"


@relation("short_segments")
def editor_filter(d):
    return "SELECT id FROM short_segments WHERE id IN (SELECT id FROM short_segments WHERE price > 950) AND status = 'confirmed' AND risk_level IN ('LOW', 'MEDIUM') AND (contains(lower(source_text), 'a') OR contains(lower(target_text), 'brand'))"


@relation("short_segments")
def web_batch_eligible(d):
    """Forced ids less confirmed ones, else new rows of the engine's risk; the
    batch of ten, and how many remain."""
    found = "SELECT id, id IN (5, 6, 7, 8) AS forced FROM short_segments WHERE (id IN (5, 6, 7, 8) AND status <> 'confirmed') OR (status = 'new' AND risk_level = 'LOW')"
    return f"SELECT id, forced, (SELECT count(*) FROM ({found}) c) - 10 AS remaining FROM ({found}) e ORDER BY forced DESC, id LIMIT 10"


@relation("short_segments")
def medical_qa_eligible(d):
    return "SELECT id FROM short_segments WHERE trim(target_text) <> '' AND status IN ('translated', 'confirmed', 'qa', 'review') ORDER BY id LIMIT 50"


@relation("glossary")
def glossary_valid_terms(d):
    """Terms that checks may use: long enough, not stop words, target too."""
    stop = ", ".join(map(repr, L.STOP_EN))
    return f"SELECT term, trim(x) AS variant FROM (SELECT term, {d.explode(d.split('target', ';'))} AS x FROM glossary WHERE length(term) >= 4 AND term NOT IN ({stop})) g WHERE length(trim(x)) >= 3 AND lower(trim(x)) NOT IN ({stop})"


@relation("memory_types")
def tm_filter(d):
    """Memory rows by quality (derived where it is missing) and text."""
    return "SELECT id, quality FROM (SELECT id, t, target, CASE WHEN id % 2 = 0 THEN 'verified' ELSE 'draft' END AS quality FROM memory_types) m WHERE quality = 'verified' AND (contains(t, 'brass') OR contains(lower(target), '1'))"


def normal_form(d, col):
    """Invisible code points dropped, white space squeezed, lower case."""
    return d.norm(d.sub(f"coalesce({col}, '')", "[\\xad​‌‍⁠﻿]+", ""))


@relation("segments", "memory")
def tm_exact_normal(d):
    """Memory lookup on the normal form: the newest entry of the form."""
    return f"SELECT s.id, m.id AS tm_id FROM (SELECT id, {d.sha(normal_form(d, 'source_text'))} AS h FROM segments) s JOIN (SELECT {d.sha(normal_form(d, 'source_text'))} AS h, max(id) AS id FROM memory GROUP BY {d.sha(normal_form(d, 'source_text'))}) m ON s.h = m.h"


@relation("segments")
def tm_aggressive_hash(d):
    """Normal form with punctuation as space."""
    return f"SELECT id, {d.sha(d.norm(d.sub(normal_form(d, 'source_text'), '[^\\p{L}\\p{N} ]+', ' ')))} AS h FROM segments"


@relation("glossary", "nation")
def glossary_lookup(d):
    return "SELECT n.n_name AS asked, g.target FROM nation n JOIN glossary g ON lower(n.n_name) = g.term"


@relation("pairs", "glossary")
def glossary_violations(d):
    """Terms that stand in the source as whole words while no variant of
    theirs stands in the target; skip lists drop short and stop words."""
    stop = ", ".join(map(repr, L.STOP_EN))
    none = " AND ".join(f"NOT contains(lower(p.target_text), lower(split_part(g.target, '; ', {i})))" for i in (1, 2))
    held = phrase_pairs(d, f"(SELECT term AS id, term AS t FROM glossary WHERE length(term) >= 3 AND term NOT IN ({stop}))", "(SELECT id, source_text AS t FROM pairs)")
    return f"SELECT p.id, g.term FROM ({held}) h JOIN pairs p ON h.b_id = p.id JOIN glossary g ON h.a_id = g.term WHERE trim(p.target_text) <> '' AND {none}"


@relation(query=False)
def dangerous_pairs(d):
    """Parts of headwords and targets that must never stand for them, in lower
    case; an application binds its own table."""
    return " UNION ALL ".join(f"SELECT '{a}' AS key, '{b}' AS bad" for a, b in L.DANGEROUS)


@relation("term_rows", "dangerous_pairs")
def dangerous_mappings(d):
    return "SELECT t.pos, m.key FROM term_rows t JOIN dangerous_pairs m ON contains(lower(t.ru), m.key) AND lower(t.en) = m.bad"


@relation("events")
def segment_detail(d):
    """Rows with the fields of their JSON side column; malformed is null."""
    return f"SELECT event_id AS id, event_type, {d.json('props', 'k')} AS k, props IS NULL AS no_props FROM events"


@relation("risked")
def risk_sample(d):
    """Risk of each project's first 200 segments; MEDIUM and 50 beyond them."""
    return "SELECT id, CASE WHEN rn <= 200 THEN level ELSE 'MEDIUM' END AS level, CASE WHEN rn <= 200 THEN score ELSE 50 END AS score FROM (SELECT id, level, score, row_number() OVER (PARTITION BY project ORDER BY segment_order) AS rn FROM risked) t"


@relation("term_rows")
def seeded_sample(d):
    """Thirty rows for inspection, the same ones for a seed."""
    return f"SELECT pos, ru, en FROM term_rows ORDER BY {d.sha("'17:' || pos")}, pos LIMIT 30"


@relation("forbidden", "term_rows")
def forbidden_union(d):
    """Two lists united; one row for each lower-case pair, the first wins."""
    return "SELECT lower(term) AS term, lower(bad) AS bad, min(list) AS list FROM (SELECT '1 own' AS list, term, bad FROM forbidden UNION ALL SELECT '2 reviewed' AS list, ru AS term, en AS bad FROM term_rows WHERE confidence = 'low') u GROUP BY lower(term), lower(bad)"


@relation("term_verdicts", "term_rows", "forbidden")
def glossary_split(d):
    """One verdict column parts the input in four outputs."""
    return "SELECT t.pos, CASE WHEN f.term IS NOT NULL THEN 'forbidden' WHEN v.reason IN ('empty', 'tilde', 'unbalanced') THEN 'rejected' WHEN v.reason IS NOT NULL OR t.confidence = 'low' THEN 'reference' ELSE 'approved' END AS verdict FROM term_rows t JOIN term_verdicts v ON t.pos = v.pos LEFT JOIN forbidden f ON lower(t.ru) = f.term AND lower(t.en) = f.bad"
