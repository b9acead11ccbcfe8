"""Terminology: tokens, candidates, ladders, forbidden pairs, coverage."""

from segq.functions import lexicons as L
from segq.operators.similarity_join import contained_pairs, few, many, phrase_pairs
from segq.plans.core import relation


@relation(query=False)
def approved_terms(d):
    """Terms that someone approved; an application binds its own table."""
    return " UNION ALL ".join(f"SELECT '{w}' AS term" for w in ("the", "that", "with", "dans", "pour", "nicht", "para", "of the", "and the"))


@relation("nation", "part", "approved_terms", query=False)
def glossary(d):
    """Approved and reference terms; reference only where unseen."""
    ref = f"SELECT DISTINCT {d.item(d.words('p_name'), 1)} AS term, 'reference' AS tier FROM part WHERE p_name IS NOT NULL"
    base = "SELECT term, 'approved' AS tier FROM approved_terms"
    return f"SELECT lower(term) AS term, min(tier) AS tier, 'T:' || lower(term) || '; ' || upper(lower(term)) AS target FROM ({base} UNION ALL {ref} UNION ALL SELECT n_name AS term, 'reference' AS tier FROM nation) g WHERE length(term) >= 2 GROUP BY lower(term)"


@relation("segments")
def tokens(d):
    return f"SELECT id, {d.size(d.distinct(d.tokens('source_text')))} AS n_tokens, {d.sha(d.join(d.sort(d.distinct(d.tokens('source_text'))), ' '))} AS token_hash FROM segments"


@relation("segments", query=False)
def segment_tokens(d):
    return f"SELECT id, {d.explode(d.distinct(d.tokens('source_text')))} AS tok FROM segments"


@relation("glossary", query=False)
def glossary_tokens(d):
    return f"SELECT term, tier, target, {d.explode(d.distinct(d.tokens('term')))} AS tok, {d.size(d.distinct(d.tokens('term')))} AS term_tokens FROM glossary"


@relation("segment_tokens", "glossary_tokens")
def token_candidates(d):
    """Inverted-index candidates: any shared token, an equi-join."""
    return "SELECT s.id, g.term, g.tier, g.target, count(*) AS shared, min(g.term_tokens) AS term_tokens FROM segment_tokens s JOIN glossary_tokens g ON s.tok = g.tok GROUP BY s.id, g.term, g.tier, g.target"


@relation("token_candidates", "segments")
def term_contains(d):
    return "SELECT c.id, c.term, instr(lower(s.source_text), c.term) AS position FROM token_candidates c JOIN segments s ON c.id = s.id WHERE contains(lower(s.source_text), c.term)"


@relation("token_candidates", "segments")
def term_whole_word(d):
    return f"SELECT c.id, c.term FROM token_candidates c JOIN segments s ON c.id = s.id WHERE c.shared = c.term_tokens AND {d.whole_word('s.source_text', 'c.term')}"


def stems(d, term: str) -> str:
    """Pattern of a phrase whose words may end otherwise: of each word the first
    three quarters, four letters at least, then any letters."""
    stem = "CAST(floor(length(x) * 75e-2) AS INT)"
    each = d.map(d.words(term), f"'{chr(92)}Q' || substring(x, 1, greatest(4, {stem})) || '{chr(92)}E'" if d.name == "duck" else f"r'\\Q' || substring(x, 1, greatest(4, {stem})) || r'\\E'")
    ending, space = (r"\p{L}*", r"[ \t\n\r\f]+")
    return f"{d.rx('(^|[^' + chr(92) + 'p{L}])(')} || array_join({each}, {d.rx(ending + space)}) || {d.rx(ending + ')')}" if d.name == "spark" else f"{d.rx('(^|[^' + chr(92) + 'p{L}])(')} || array_to_string({each}, {d.rx(ending + space)}) || {d.rx(ending + ')')}"


@relation("segments", "glossary")
def term_stem(d):
    """Terms of one or more words in any ending: the term itself anywhere, else
    its stems in a row from the beginning of a word; the form found.  A term is
    asked for by the first letters of its longest stem, which begin a word; few
    terms are looked for in each segment as it is read."""
    held = contained_pairs(d, "(SELECT term AS id, term AS t FROM glossary)", "(SELECT id, lower(source_text) AS t FROM segments)")
    longest = f"{d.item(d.by_length(d.words('term')), 1)}"
    keys = f"SELECT term, {stems(d, 'term')} AS pattern, substring({longest}, 1, 4) AS head FROM glossary WHERE trim(term) <> ''"
    terms = "(SELECT *, term AS t FROM glossary)"
    rows = "segments" if d.name == "duck" else f"(SELECT * FROM segments WHERE {many(terms)})"
    heads = f"SELECT DISTINCT id, head FROM (SELECT id, {d.explode(d.heads(d.distinct(d.all('lower(source_text)', '[^ ' + chr(92) + 't' + chr(92) + 'n]+'))))} AS head FROM {rows}) h"
    near = f"SELECT DISTINCT s.id, g.term, g.pattern FROM ({heads}) s JOIN ({keys}) g ON s.head = g.head"
    each = ""
    if d.name == "spark":
        asked = few(f"(SELECT *, term AS t FROM ({keys}) k)", "struct(term, pattern, ' ' || head AS head)")
        spaced = "' ' || replace(replace(low, chr(9), ' '), chr(10), ' ')"
        found = f"SELECT id, low, explode(filter(asked, x -> contains(spaced, x.head) AND NOT contains(low, x.term))) AS g FROM (SELECT id, low, {spaced} AS spaced, {asked} AS asked FROM (SELECT id, lower(source_text) AS low FROM segments WHERE id IS NOT NULL) l) p WHERE NOT {many(terms)}"
        each = f"UNION ALL SELECT id, term, form FROM (SELECT id, g.term, {d.ext_of('low', 'g.pattern', 2)} AS form FROM ({found}) f) w WHERE form <> ''\n"
    return f"""SELECT id, term, term AS form FROM (SELECT b_id AS id, a_id AS term FROM ({held}) h) e
{each}UNION ALL SELECT id, term, form FROM (SELECT n.id, n.term, {d.ext_of('lower(s.source_text)', 'n.pattern', 2)} AS form, contains(lower(s.source_text), n.term) AS exact FROM ({near}) n JOIN {rows} s ON n.id = s.id) m WHERE NOT exact AND form <> ''"""


@relation("token_candidates", "segments", query=False)
def term_ladder(d):
    return f"""SELECT c.id, c.term, c.tier, c.target, CASE WHEN contains(s.source_text, c.term) THEN 'exact' WHEN contains(lower(s.source_text), c.term) THEN 'case_insensitive' WHEN c.shared = c.term_tokens THEN 'partial' END AS match_type
FROM token_candidates c JOIN segments s ON c.id = s.id"""


@relation("token_candidates", "segments", query=False)
def fuzzy_candidates(d):
    """Candidates that stand nowhere in the segment, in compare form beside the
    segment's head of three times the term's length, where their lengths allow a
    ratio of 0.72."""
    form = lambda c: f"trim({d.sub(f'lower({c})', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_ ' + chr(92) + 't' + chr(92) + 'n]', '')})"
    return f"""SELECT * FROM (SELECT c.id, c.term, c.tier, c.shared = c.term_tokens AS whole, {form('c.term')} AS a, {form('substring(s.source_text, 1, 3 * length(c.term))')} AS b
FROM token_candidates c JOIN segments s ON c.id = s.id WHERE length(c.term) <= 60 AND NOT contains(lower(s.source_text), c.term)) f WHERE 2 * least(length(a), length(b)) >= 0.72e0 * (length(a) + length(b))"""


@relation("term_ladder")
def term_match_top15(d):
    prio = "CASE tier WHEN 'approved' THEN 0 ELSE 10 END + CASE match_type WHEN 'exact' THEN 0 WHEN 'case_insensitive' THEN 1 ELSE 2 END"
    return f"""SELECT id, term, tier, match_type, score, rn FROM (SELECT id, term, tier, match_type, CASE match_type WHEN 'exact' THEN 1e0 WHEN 'case_insensitive' THEN 98e-2 ELSE 85e-2 END AS score,
row_number() OVER (PARTITION BY id ORDER BY {prio}, length(term) DESC, term) AS rn FROM term_ladder WHERE match_type IS NOT NULL) t WHERE rn <= 15"""


@relation("term_ladder", "token_candidates", "segments", query=False)
def term_counts(d):
    """Matches of each segment, at most fifteen.  A term with all of its tokens
    matches; only the others are looked for in the text, once a segment."""
    if d.name == "spark":
        by_id = "SELECT id, count_if(shared = term_tokens) AS whole, collect_list(CASE WHEN shared < term_tokens THEN term END) AS parts FROM token_candidates GROUP BY id"
        found = "size(filter(parts, x -> contains(source_text, x) OR contains(lower(source_text), x)))"
        return f"SELECT id, least(15, sum(n)) AS n FROM (SELECT c.id, whole + {found} AS n FROM ({by_id}) c JOIN segments s ON c.id = s.id) m GROUP BY id HAVING sum(n) > 0"
    return "SELECT id, least(15, count(*)) AS n FROM term_ladder WHERE match_type IS NOT NULL GROUP BY id"


@relation("term_match_top15", "glossary")
def prompt_context(d):
    """Approved and reference lines of a segment's terms, first synonym."""
    line = "g.tier || ':' || t.term || '=' || split_part(g.target, '; ', 1)"
    return f"SELECT t.id, {d.joined(line, '|')} AS context FROM term_match_top15 t JOIN glossary g ON t.term = g.term WHERE t.rn <= 5 GROUP BY t.id"


@relation("segments", "term_match_top15")
def glossary_coverage(d):
    return "SELECT count(*) AS segments, count(m.id) AS covered, round(100 * count(m.id) / (count(*) * 1e0), 1) AS percent FROM segments s LEFT JOIN (SELECT DISTINCT id FROM term_match_top15) m ON s.id = m.id"


@relation("conversations", query=False)
def pairs(d):
    """Source/target pairs: a user turn and the turn that follows it.  The id is
    the conversation and the turn's place in it, so it never repeats."""
    w = "(PARTITION BY conv_id ORDER BY turn, role, text)"
    return f"""SELECT conv_id || ':' || place AS id, conv_id AS project, text AS source_text, target_text, place AS turn FROM (SELECT conv_id, role, row_number() OVER {w} - 1 AS place, coalesce(text, '') AS text, coalesce(lead(text) OVER {w}, '') AS target_text FROM conversations) t WHERE role = 'user'"""


@relation(query=False)
def forbidden(d):
    rows = [f"SELECT {i} AS pos, '{a}' AS term, '{b}' AS bad, '{c}' AS reason" for i, (a, b, c) in enumerate(L.FORBIDDEN)]
    return " UNION ALL ".join(rows)


@relation("segments", "forbidden", "glossary")
def forbidden_pre(d):
    """Source holds the term as a whole word; preferred target if approved."""
    held = phrase_pairs(d, "(SELECT pos AS id, term AS t FROM forbidden)", "(SELECT id, source_text AS t FROM segments)")
    return f"""SELECT s.b_id AS id, f.term, f.bad, CASE WHEN contains(f.reason, 'dangerous') THEN 'critical' ELSE 'warning' END AS severity, split_part(g.target, '; ', 1) AS preferred
FROM ({held}) s JOIN forbidden f ON s.a_id = f.pos LEFT JOIN glossary g ON g.term = f.term AND g.tier = 'approved'"""


@relation("documents", "forbidden")
def forbidden_post(d):
    """Target holds the forbidden word; one alert per word, milder if the
    source lacks the term."""
    held = phrase_pairs(d, "(SELECT pos AS id, bad AS t FROM forbidden)", "(SELECT doc_id AS id, text AS t FROM documents)")
    return f"""SELECT id, bad, term, severity FROM (SELECT s.b_id AS id, f.bad, f.term, CASE WHEN {d.whole_word('s.b_t', 'f.term')} THEN CASE WHEN contains(f.reason, 'dangerous') THEN 'critical' ELSE 'warning' END ELSE 'info' END AS severity, row_number() OVER (PARTITION BY s.b_id, f.bad ORDER BY f.pos) AS rn
FROM ({held}) s JOIN forbidden f ON s.a_id = f.pos) t WHERE rn = 1"""


@relation("forbidden")
def forbidden_words(d):
    return "SELECT DISTINCT lower(bad) AS word FROM forbidden"
