"""Glossary builds: repair, audits, final cleaning, parsing of dictionaries."""

from segq.functions import lexicons as L
from segq.operators.scalars import repaired_en
from segq.operators.similarity_join import contained_pairs
from segq.plans.core import relation


@relation("term_rows", "adjective_test")
def glossary_fix(d):
    """Repair, drop artifacts, consolidate by headword."""
    return f"SELECT lower(t.ru) AS ru, {d.joined_set(repaired_en(d, 't.en'), '; ')} AS en, count(*) AS n FROM term_rows t JOIN adjective_test a ON t.pos = a.pos WHERE NOT (a.is_adjective AND {d.size(d.words('t.en'))} >= 2) GROUP BY lower(t.ru)"


def issue_flags(d):
    ru, en = d.size(d.words("ru")), d.size(d.words("en"))
    return (("lost_qualifier", f"{ru} >= 3 AND {en} = 1"), ("generic", f"{en} = 1 AND lower(en) IN ({', '.join(map(repr, L.GENERIC))})"), ("incomplete", d.has("lower(en)", "(^| )(of|the|and|in|with)$")), ("non_ascii", d.has("en", "[^\\x00-\\x7F]")), ("short", "length(en) < 4"))


@relation("term_rows")
def consolidator_qa(d):
    return f"SELECT pos, {d.join('issues', ',')} AS issues, {d.size('issues')} AS n FROM (SELECT pos, {d.flags(*issue_flags(d))} AS issues FROM term_rows) t"


@relation("term_rows")
def audit_pairs(d):
    """Five checks: none approves, one refers, more reject."""
    return f"SELECT pos, CASE {d.size('issues')} WHEN 0 THEN 'approved' WHEN 1 THEN 'reference' ELSE 'rejected' END AS verdict, {d.join('issues', ',')} AS issues FROM (SELECT pos, {d.flags(*issue_flags(d))} AS issues FROM term_rows) t"


@relation("audit_pairs", "term_rows")
def audit_stats(d):
    """Reason counts and averages by verdict."""
    return f"SELECT a.verdict, a.issues, count(*) AS n, round(avg(length(t.ru)), 3) AS mean_length, round(avg({d.size(d.words('t.ru'))}), 3) AS mean_words FROM audit_pairs a JOIN term_rows t ON a.pos = t.pos GROUP BY a.verdict, a.issues"


@relation("term_rows", "dangerous_mappings")
def final_clean(d):
    rules = (("dangerous", "m.pos IS NOT NULL"), ("junk", d.has("en", "^[^A-Za-z]*$")), ("bracket_only", d.has("en", "^\\(.*\\)$")), ("too_many_words", f"{d.size(d.words('ru'))} > 12"), ("ratio", "length(ru) > 5 * length(en) OR length(en) > 5 * length(ru)"))
    verdict = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in rules) + " ELSE 'keep' END"
    return f"SELECT t.pos, {verdict} AS verdict FROM term_rows t LEFT JOIN (SELECT DISTINCT pos FROM dangerous_mappings) m ON t.pos = m.pos"


@relation("term_rows")
def orientation_swap(d):
    """Sides whose scripts are reversed change places."""
    cyr = lambda c: d.n(c, "[Ѐ-ӿ]")
    return f"SELECT pos, CASE WHEN {cyr('b')} > {cyr('a')} THEN b ELSE a END AS ru, CASE WHEN {cyr('b')} > {cyr('a')} THEN a ELSE b END AS en, {cyr('b')} > {cyr('a')} AS swapped FROM (SELECT pos, CASE WHEN pos % 2 = 0 THEN en ELSE ru || ' слово' END AS a, CASE WHEN pos % 2 = 0 THEN ru || ' слово' ELSE en END AS b FROM term_rows) t"


@relation("term_rows")
def web_glossary_load(d):
    """First row of each exact headword; both sides of three letters at least
    that begin with a letter; categories mapped, with a default."""
    return f"SELECT ru, en, CASE category WHEN 'ECONO' THEN 'economy' WHEN 'LARGE' THEN 'size' ELSE 'general' END AS category FROM (SELECT pos, ru, en, category, row_number() OVER (PARTITION BY ru ORDER BY pos) AS rn FROM term_rows WHERE length(ru) >= 3 AND length(en) >= 3 AND {d.has('ru', '^[\\p{L}]')} AND {d.has('en', '^[\\p{L}]')}) t WHERE rn = 1"


@relation("term_rows")
def prompt_glossary(d):
    """The first 500 rows with both sides set, as prompt lines."""
    return "SELECT pos, ru || ' = ' || en AS line FROM term_rows WHERE trim(ru) <> '' AND trim(en) <> '' ORDER BY pos LIMIT 500"


@relation("segments", "forbidden")
def forbidden_scan(d):
    """Substring scan straight from the list: term, reason, first position."""
    held = contained_pairs(d, "(SELECT pos AS id, lower(term) AS t FROM forbidden)", "(SELECT id, lower(source_text) AS t FROM segments)")
    return f"SELECT s.b_id AS id, f.term, f.reason, instr(s.b_t, s.a_t) AS position FROM ({held}) s JOIN forbidden f ON s.a_id = f.pos"


@relation("lines")
def dictionary_slice(d):
    """Lines between the first long line (start) and the first line after it
    that is empty (end)."""
    first = "min(CASE WHEN length(line) > 80 THEN pos END) OVER (PARTITION BY id)"
    return f"SELECT id, pos, length(line) AS n FROM (SELECT id, pos, line, begins, min(CASE WHEN pos > begins AND trim(line) = '' THEN pos END) OVER (PARTITION BY id) AS ends FROM (SELECT id, pos, line, {first} AS begins FROM lines) a) b WHERE pos > begins AND (ends IS NULL OR pos < ends)"


@relation("lines")
def block_parse(d):
    """Alternating lines: term, translation, definition."""
    return "SELECT id, CAST(floor((rn - 1) / 3e0) AS BIGINT) AS entry, max(CASE WHEN (rn - 1) % 3 = 0 THEN line END) AS term, max(CASE WHEN (rn - 1) % 3 = 1 THEN line END) AS translation, max(CASE WHEN (rn - 1) % 3 = 2 THEN line END) AS definition FROM (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM lines WHERE trim(line) <> '') t GROUP BY id, CAST(floor((rn - 1) / 3e0) AS BIGINT)"


@relation("lineitem")
def column_gap(d):
    """Widest gap between word places in the middle of a page (here: lines of
    an order as words of a page); narrow gaps give 48 percent of the width."""
    return "SELECT page, coalesce(max_by(mid, gap), 48e0) AS split_at FROM (SELECT page, x - before AS gap, (x + before) / 2e0 AS mid FROM (SELECT l_orderkey AS page, l_quantity * 2e0 AS x, lag(l_quantity * 2e0) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS before FROM lineitem) w WHERE before >= 30 AND x <= 70 AND x - before > 20) g GROUP BY page"
