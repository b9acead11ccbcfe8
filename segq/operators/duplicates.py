"""Duplicate analysis: exact groups, fuzzy pairs, ids, representatives."""

from segq.operators.similarity_join import edit_pairs
from segq.plans.core import dense, relation


@relation("documents", query=False)
def segments(d):
    """Segments of the project: id, order, type and text."""
    return "SELECT doc_id AS id, doc_id AS segment_order, lang AS block_type, source AS project, coalesce(text, '') AS source_text FROM documents"


@relation("part", query=False)
def short_segments(d):
    """Short repetitive segments; status, type and risk come from columns."""
    return f"SELECT p_partkey AS id, p_name AS source_text, {d.sha(d.norm('p_name'))} AS h, p_type AS block_type, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS target_text, CASE WHEN p_size > 40 THEN 'CRITICAL' WHEN p_size > 30 THEN 'HIGH' WHEN p_size > 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN p_size % 3 = 1 THEN 'confirmed' ELSE 'new' END AS status, p_retailprice AS price FROM part"


@relation("segments")
def norm_hash(d):
    return f"SELECT id, {d.norm('source_text')} AS norm, {d.sha(d.norm('source_text'))} AS hash FROM segments"


@relation("short_segments")
def dup_exact_groups(d):
    return "SELECT h, min(id) AS representative, count(*) AS n, floor((count(*) - 1) * 5e-1 + 5e-1) / 100 AS saving FROM short_segments GROUP BY h HAVING count(*) >= 2"


@relation("short_segments", "dup_exact_groups")
def dup_assign(d):
    """Groups by representative, numbered from 0 as they are first seen."""
    return f"""SELECT s.id, g.representative AS group_id, g.place - 1 AS group_number, s.id = g.representative AS is_representative, coalesce(g.n - 1, 0) AS duplicate_count
FROM short_segments s LEFT JOIN ({dense("dup_exact_groups", "representative")}) g ON s.h = g.h"""


@relation("dup_assign")
def dup_summary(d):
    return "SELECT count(*) AS total, count_if(group_id IS NOT NULL) AS in_groups, count(DISTINCT group_id) AS n_groups, count_if(is_representative) AS representatives, count_if(group_id IS NULL) + count(DISTINCT group_id) AS unique_segments FROM dup_assign"


@relation("dup_exact_groups")
def dup_top20(d):
    return "SELECT h, representative, n, saving FROM dup_exact_groups ORDER BY n DESC, representative LIMIT 20"


@relation("short_segments", query=False)
def distinct_texts(d):
    return f"SELECT min(id) AS id, {d.norm('source_text')} AS t FROM short_segments GROUP BY {d.norm('source_text')}"


@relation("distinct_texts")
def dup_fuzzy_pairs(d):
    """Pairs of distinct texts whose Levenshtein ratio is at least 0.6, with or
    without a common token; no pair is lost."""
    return f"SELECT a_id, b_id, round(similarity, 3) AS similarity FROM ({edit_pairs(d, 'distinct_texts', 'distinct_texts', 0.6)}) p WHERE a_id < b_id"


@relation("short_segments")
def dup_representative(d):
    """Best member of each group: with target, lowest risk, not a table."""
    rank = "CASE risk_level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END"
    return f"""SELECT id, h, first_value(id) OVER w AS representative_id, row_number() OVER w = 1 AS is_representative, CASE WHEN row_number() OVER w = 1 THEN 'ready' ELSE 'propagated_pending_review' END AS state
FROM short_segments WINDOW w AS (PARTITION BY h ORDER BY CASE WHEN trim(target_text) <> '' THEN 0 ELSE 1 END, {rank}, CASE WHEN contains(block_type, 'TABLE') THEN 1 ELSE 0 END, id)"""


@relation("short_segments", "dup_representative")
def dup_propagate(d):
    return """SELECT m.id, r.id AS representative_id, r.target_text AS target_text, CASE WHEN m.block_type = r.block_type OR m.risk_level = 'LOW' THEN 'propagated' ELSE 'skipped' END AS outcome
FROM dup_representative p JOIN short_segments m ON p.id = m.id JOIN short_segments r ON p.representative_id = r.id
WHERE NOT p.is_representative AND r.status = 'confirmed' AND trim(r.target_text) <> ''"""


@relation("conversations")
def adjacent_dedup(d):
    """Drops a turn that repeats the turn before it, and texts under two
    characters or of digits and punctuation alone."""
    return f"""SELECT conv_id, turn, text FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS text, lag(trim(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) t
WHERE length(text) >= 2 AND {d.has('text', '[\\p{L}]')} AND (before IS NULL OR before <> text)"""


@relation("segments")
def upload_rules(d):
    n = d.size(d.words("source_text"))
    return f"SELECT id, CASE WHEN {n} > 30 THEN 'high' WHEN {n} > 8 THEN 'medium' ELSE 'low' END AS risk, 'GPT_REQUIRED' AS route FROM segments"


@relation("segments")
def web_dedupe_stats(d):
    key = f"trim({d.sub(d.norm('source_text'), '[^\\p{L}\\p{N} ]+', '')})"
    return f"SELECT count(*) AS total, count(DISTINCT k) AS unique_texts, sum(CASE WHEN first_of AND n > 1 THEN 1 ELSE 0 END) AS repeated_groups FROM (SELECT k, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY id) = 1 AS first_of FROM (SELECT id, {key} AS k FROM segments) s) t"
