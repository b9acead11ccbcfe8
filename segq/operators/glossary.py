"""Glossary consolidation and cleaning rules over term rows."""

from segq.functions import lexicons as L
from segq.plans.core import relation


@relation("part", query=False)
def term_rows(d):
    return "SELECT p_partkey AS pos, p_name AS ru, p_brand AS en, p_type AS source, CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN p_size % 4 = 0 THEN '' ELSE substring(p_type, 1, 5) END AS category FROM part"


RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@relation("term_rows")
def glossary_precedence_anti(d):
    """Reference rows enter only where no approved row has the key."""
    return "SELECT r.pos, r.ru, r.en FROM term_rows r WHERE r.confidence = 'low' AND NOT EXISTS (SELECT 1 FROM term_rows a WHERE a.confidence = 'high' AND lower(a.ru) = lower(r.ru) AND lower(a.en) = lower(r.en))"


@relation("term_rows")
def glossary_accumulate(d):
    """Key (ru, en): sources united, best confidence, first known category."""
    return f"SELECT lower(ru) AS ru, lower(en) AS en, {d.joined_set('source', '|')} AS sources, max({RANK}) AS confidence_rank, coalesce(min_by(CASE WHEN category <> '' THEN category END, CASE WHEN category <> '' THEN pos END), '') AS category FROM term_rows GROUP BY lower(ru), lower(en)"


@relation("term_rows")
def glossary_consolidate(d):
    return f"SELECT lower(ru) AS ru, {d.joined_set('en', '; ')} AS variants, max({RANK}) AS confidence_rank, {d.joined_set('source', '|')} AS sources FROM term_rows GROUP BY lower(ru)"


@relation("term_rows")
def glossary_near_dup(d):
    key = d.sub("lower(en)", "[^a-z0-9]+", "")
    return f"SELECT pos, ru, en FROM (SELECT pos, ru, en, row_number() OVER (PARTITION BY lower(ru), {key} ORDER BY pos) AS rn FROM term_rows) t WHERE rn = 1"


@relation("term_rows")
def glossary_merge_full_outer(d):
    """Main and recovered rows (those of low confidence) merged by key; unseen
    variants are appended."""
    side = lambda name, test: f"(SELECT lower(ru) AS k, {d.joined_set('en', '; ')} AS {name} FROM term_rows WHERE {test} GROUP BY lower(ru))"
    return f"SELECT coalesce(m.k, r.k) AS ru, coalesce(m.main, '') AS main, coalesce(r.recovered, '') AS recovered, m.k IS NULL AS inserted FROM {side('main', "confidence <> 'low'")} m FULL OUTER JOIN {side('recovered', "confidence = 'low'")} r ON m.k = r.k"


@relation("term_rows")
def term_mode(d):
    """Most frequent target per term; the first seen wins ties."""
    return "SELECT ru, en, n FROM (SELECT ru, en, n, row_number() OVER (PARTITION BY ru ORDER BY n DESC, first_pos) AS rn FROM (SELECT ru, en, count(*) AS n, min(pos) AS first_pos FROM term_rows GROUP BY ru, en) c) t WHERE rn = 1"


@relation("glossary_consolidate")
def source_histogram(d):
    return f"SELECT x AS source, count(*) AS n FROM (SELECT {d.explode(d.split('sources', '|'))} AS x FROM glossary_consolidate) t GROUP BY x"


@relation("term_rows", query=False)
def term_verdicts(d):
    n = d.size(d.filter(d.tokens("en"), f"x NOT IN ({', '.join(map(repr, L.STOP_EN))})"))
    return f"""SELECT pos, ru, en, CASE WHEN trim(en) = '' OR trim(ru) = '' THEN 'empty' WHEN contains(ru, '~') OR contains(en, '~') THEN 'tilde' WHEN {d.size(d.words('ru'))} = 1 AND {n} >= 2 THEN 'adjective_artifact' WHEN {n} = 1 AND {d.size(d.words('ru'))} >= 3 THEN 'generic_single_word' WHEN length(ru) > 40 THEN 'too_long' WHEN {d.n('ru', '[(]')} <> {d.n('ru', '[)]')} THEN 'unbalanced' END AS reason FROM term_rows"""


@relation("term_verdicts")
def glossary_clean(d):
    return "SELECT pos, ru, en, coalesce(reason, 'keep') AS verdict FROM term_verdicts"


@relation("term_verdicts")
def glossary_reject_top5(d):
    return "SELECT coalesce(reason, 'keep') AS reason, count(*) AS n FROM term_verdicts GROUP BY coalesce(reason, 'keep') ORDER BY count(*) DESC, coalesce(reason, 'keep') LIMIT 5"


@relation("term_rows")
def glossary_stats(d):
    return f"SELECT category, count(*) AS n, min(length(ru)) AS min_length, max(length(ru)) AS max_length, round(avg({d.size(d.words('ru'))}), 3) AS mean_words FROM term_rows GROUP BY category"


@relation("part")
def glossary_ingest(d):
    """Variant split on ';' after parentheses go; one row per variant."""
    v = d.split(d.sub("p_name || '; ' || lower(p_brand) || ' (note)'", "[(][^)]*[)]", ""), ";")
    return f"SELECT DISTINCT term, variant FROM (SELECT p_type AS term, trim(x) AS variant FROM (SELECT p_type, {d.explode(v)} AS x FROM part) a) t WHERE variant <> ''"


@relation("part")
def glossary_page(d):
    return "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY lower(p_name), p_partkey LIMIT 50 OFFSET 100"
