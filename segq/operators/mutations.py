"""Inserts, updates, upserts and deletes as rewrites of whole frames."""

from segq.plans.core import relation


@relation("customer")
def project_insert(d):
    return "SELECT c_custkey AS project, c_name AS title FROM customer UNION ALL SELECT max(c_custkey) + 1 AS project, 'new project' AS title FROM customer"


@relation("short_segments")
def preflight_update(d):
    """Only whitelisted columns change."""
    return "SELECT id, source_text, coalesce(CASE WHEN risk_level = 'CRITICAL' THEN 'HUMAN_REVIEW_REQUIRED' END, 'GPT_REQUIRED') AS route, status FROM short_segments"


@relation("short_segments")
def web_update(d):
    """A text makes a new segment translated; comments are appended."""
    return "SELECT s.id, coalesce(p.target, s.target_text) AS target, CASE WHEN s.status = 'new' AND trim(coalesce(p.target, '')) <> '' THEN 'translated' ELSE s.status END AS status, CASE WHEN p.note IS NULL THEN 0 ELSE 1 END AS comments FROM short_segments s LEFT JOIN (SELECT id, 'T ' || source_text AS target, CASE WHEN price > 1500 THEN 'look' END AS note FROM short_segments WHERE risk_level = 'LOW') p ON s.id = p.id"


@relation("glossary", "term_rows")
def glossary_upsert(d):
    """By term: incoming rows replace, new ones come first."""
    return "SELECT coalesce(n.ru, g.term) AS term, coalesce(n.en, g.target) AS target, CASE WHEN g.term IS NULL THEN 0 ELSE 1 END AS place FROM glossary g FULL OUTER JOIN (SELECT split_part(lower(ru), ' ', 1) AS ru, min(en) AS en FROM term_rows WHERE confidence = 'high' GROUP BY split_part(lower(ru), ' ', 1)) n ON g.term = n.ru"


@relation("glossary", "nation")
def glossary_delete(d):
    return "SELECT term, target FROM glossary g WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE lower(n.n_name) = g.term)"


@relation("glossary")
def glossary_insert(d):
    return "SELECT term, target, tier FROM glossary UNION ALL SELECT 'new term' AS term, 'neu' AS target, 'approved' AS tier"


@relation("memory", "labels")
def tm_delete(d):
    return "SELECT source_hash, id FROM memory m WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.id AND l.toxic = 1)"
