"""Project-wide consistency: one source, one target."""

from segq.operators.similarity_join import contained_pairs
from segq.plans.core import relation


@relation("short_segments")
def consistency_source(d):
    return f"SELECT h, count(DISTINCT trim(target_text)) AS n_targets, count(*) AS n, {d.joined_set('trim(target_text)', '|')} AS targets FROM short_segments WHERE trim(target_text) <> '' GROUP BY h HAVING count(DISTINCT trim(target_text)) > 1"


@relation("pairs")
def consistency_names(d):
    name = "[A-Z][a-z]+( [A-Z][a-z]+)+"
    return f"SELECT x AS name, count(DISTINCT other) AS n_targets, count(*) AS n FROM (SELECT {d.explode(d.distinct(d.all('source_text', name)))} AS x, {d.ext('target_text', '(' + name + ')')} AS other FROM pairs) t WHERE other <> '' GROUP BY x HAVING count(DISTINCT other) > 1"


@relation("pairs")
def consistency_abbrev(d):
    return f"SELECT x AS abbreviation, count(DISTINCT other) AS n_targets FROM (SELECT {d.explode(d.distinct(d.all('source_text', '[A-Z]{2,6}')))} AS x, {d.ext('target_text', '([A-Z]{2,6})')} AS other FROM pairs) t WHERE other <> '' GROUP BY x HAVING count(DISTINCT other) > 1"


@relation("short_segments", "dup_assign")
def consistency_group(d):
    return f"SELECT a.group_id, count(DISTINCT s.target_text) AS n_targets, min(s.id) AS first_id FROM dup_assign a JOIN short_segments s ON a.id = s.id WHERE a.group_id IS NOT NULL AND trim(s.target_text) <> '' GROUP BY a.group_id HAVING count(DISTINCT s.target_text) > 1"


@relation("pairs", "glossary")
def consistency_term(d):
    """Targets that lack the approved target of a term that the source
    contains."""
    held = contained_pairs(d, "(SELECT term AS id, term AS t FROM glossary WHERE tier = 'approved')", "(SELECT id, lower(source_text) AS t FROM pairs)")
    return f"SELECT g.term, count(DISTINCT s.target_text) AS n_targets, count(DISTINCT s.id) AS n FROM ({held}) h JOIN pairs s ON h.b_id = s.id JOIN glossary g ON h.a_id = g.term WHERE NOT contains(lower(s.target_text), lower(split_part(g.target, '; ', 1))) AND s.target_text <> '' GROUP BY g.term HAVING count(DISTINCT s.target_text) > 1"


@relation("consistency_source", "consistency_names", "consistency_abbrev", "consistency_group", "consistency_term")
def consistency_counts(d):
    parts = {"source": "consistency_source", "name": "consistency_names", "abbreviation": "consistency_abbrev", "group": "consistency_group", "term": "consistency_term"}
    return " UNION ALL ".join(f"SELECT '{k}' AS type, 'warning' AS severity, count(*) AS alerts, coalesce(sum(n_targets), 0) AS targets FROM {v}" for k, v in parts.items())


@relation("pairs", "glossary", query=False)
def term_lacks(d):
    """Pairs whose source contains an approved term and whose target lacks it."""
    held = contained_pairs(d, "(SELECT term AS id, term AS t FROM glossary WHERE tier = 'approved')", "(SELECT id, lower(source_text) AS t FROM pairs)")
    return f"SELECT g.term, s.id FROM ({held}) h JOIN pairs s ON h.b_id = s.id JOIN glossary g ON h.a_id = g.term WHERE NOT contains(lower(s.target_text), lower(split_part(g.target, '; ', 1))) AND s.target_text <> ''"


@relation("short_segments", "dup_assign", "pairs", "term_lacks", "consistency_source", "consistency_names", "consistency_abbrev", "consistency_group", "consistency_term", query=False)
def consistency_members(d):
    """(type, key, id) of every segment that an alert lists."""
    name = "[A-Z][a-z]+( [A-Z][a-z]+)+"
    of = lambda p: f"SELECT {d.explode(d.distinct(d.all('source_text', p)))} AS x, id, {d.ext('target_text', '(' + p + ')')} AS other FROM pairs"
    return f"""SELECT 'source' AS type, c.h AS key, 's' || s.id AS id FROM consistency_source c JOIN short_segments s ON c.h = s.h WHERE trim(s.target_text) <> ''
UNION ALL SELECT 'name', c.name, 'p' || p.id FROM consistency_names c JOIN ({of(name)}) p ON c.name = p.x WHERE p.other <> ''
UNION ALL SELECT 'abbreviation', c.abbreviation, 'p' || p.id FROM consistency_abbrev c JOIN ({of('[A-Z]{2,6}')}) p ON c.abbreviation = p.x WHERE p.other <> ''
UNION ALL SELECT 'group', 'g' || c.group_id, 's' || s.id FROM consistency_group c JOIN dup_assign a ON c.group_id = a.group_id JOIN short_segments s ON a.id = s.id WHERE trim(s.target_text) <> ''
UNION ALL SELECT 'term', c.term, 'p' || t.id FROM consistency_term c JOIN term_lacks t ON c.term = t.term"""


#: Members of one row of an alert, at most.
MEMBERS = 100


@relation("consistency_members")
def consistency_run(d):
    """Alerts of the five detectors as rows: type, severity, key and members.
    Members are dealt by a hash to 256 parts of a key and cut to rows of
    ``MEMBERS``, so a key with many of them is never one row or one task."""
    part = f"substring({d.sha('id')}, 1, 2)"
    return f"""SELECT type, 'warning' AS severity, key, part || '-' || piece AS chunk, count(*) AS n, {d.joined('id', ' ')} AS members
FROM (SELECT type, key, id, part, CAST(floor((row_number() OVER (PARTITION BY type, key, part ORDER BY id) - 1) / {MEMBERS}e0) AS INT) AS piece FROM (SELECT type, key, id, {part} AS part FROM consistency_members) m) c GROUP BY type, key, part, piece"""


@relation("consistency_run")
def alert_fan_out(d):
    """Alerts of all five types, back to one row per segment."""
    return f"SELECT id, count(*) AS alerts, {d.joined_set('type', ',')} AS types FROM (SELECT type, {d.explode(d.split('members', ' '))} AS id FROM consistency_run) a GROUP BY id"
