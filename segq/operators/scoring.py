"""Risk, semantic and structural scores: row-wise rules over one feature row."""

from segq.functions import lexicons as L
from segq.plans.core import relation

#: Doubled opening brackets of any kind.
NESTED = r"\(\(|\[\[|\{\{"


@relation("segments", query=False)
def features(d):
    """Counts that every score reads; tokens are extracted once."""
    t, low, unit = "source_text", "lower(source_text)", "(" + "|".join(L.UNITS) + "|%)"
    quoted = lambda words: ", ".join(repr(w) for w in words)
    among = lambda words: d.size(d.filter("hits", f"x IN ({quoted(words)})"))
    lists = {"polarity": L.POLARITY, "course": L.COURSE, "direction": L.DIRECTION, "diagnosis": L.DIAGNOSIS, "treatment": L.TREATMENT, "lab": L.LAB, "procedures": L.PROCEDURE, "medication": L.MEDICATION, "logic": L.LOGIC, "danger": L.DANGER, "degrees": L.DEGREES, "institution": L.INSTITUTION, "specialty": L.SPECIALTY, "titles": L.TITLE}
    every = quoted(sorted({w for words in lists.values() for w in words}))
    roots = d.n_any("low", L.ROOTS)
    pre, post = (" + ".join(f"CASE WHEN contains(padded, ' {w} ') THEN 1 ELSE 0 END" for w in words) for words in ([a for a, _, _ in L.FORBIDDEN], sorted({b for _, b, _ in L.FORBIDDEN})))
    suffix = d.size(d.filter("tok", " OR ".join(d.ends("x", f"'{s}'") for s in L.SUFFIXES)))
    n_words, n_abbr = d.size("wrd"), d.size(d.filter("wrd", d.has("x", "^[A-Z]{2,6}[.,;:]?$")))
    short_caps, words = d.size(d.filter("wrd", "length(x) <= 4 AND " + d.has("x", "^[A-Z]+$"))), f"{d.words(t)} AS wrd, "
    if d.name == "spark":  # words are counted where they stand, without an array of them
        space = r"[^ \t\n\x0b\f\r]"
        n_words, words = d.n(t, f"{space}+"), ""
        n_abbr, short_caps = (d.n(t, f"(?<!{space}){word}(?!{space})") for word in ("[A-Z]{2,6}[.,;:]?", "[A-Z]{1,4}"))
    counted = ", ".join(f"{among(words)} AS n_{name}" for name, words in lists.items())
    return f"""SELECT id, segment_order, block_type, project, source_text, n_words, length(trim(source_text)) AS n_chars,
{d.n('low', f'[0-9]+([.,][0-9]+)? ?{unit}')} AS n_units, {d.n('source_text', '[0-9]+([.,][0-9]+)? ?[-–] ?[0-9]+')} AS n_ranges, {d.n('source_text', '[0-9]+')} AS n_numbers,
{n_abbr} AS n_abbr, {short_caps} AS n_short_caps, {d.n('source_text', '[A-Z][.] ?[A-Z][a-z]+')} AS n_initials, {d.n('source_text', '[A-Z][a-z]+')} AS n_caps,
{roots} AS n_roots, {suffix} AS n_suffixes, {d.n_of(t, '[/–-]', '/–-')} AS n_marks, {d.n_of(t, '[|→←]', '|→←')} AS n_pipes, {d.n_of(t, NESTED, ('((', '[[', '{{'))} AS n_nested, {d.n_of(t, '[;,]', ';,')} AS n_separators, {d.n_of(t, '[(]', '(')} AS n_parens,
{d.has('source_text', '[\\n\\t]')} AS has_breaks, {d.has('source_text', '^[A-Z]')} AS capital_start, {d.has('source_text', '[a-z]$')} AS letter_end, {counted}, {pre} AS n_forbidden_pre, {post} AS n_forbidden_post
FROM (SELECT *, {n_words} AS n_words, {d.filter("tok", f"x IN ({every})")} AS hits FROM (SELECT *, {d.tokens(t)} AS tok, {words}{low} AS low, {d.padded(t)} AS padded FROM segments) a) s"""


#: (feature test, points, label), in order; weights are fixed values.
RISK = (
    ("n_units > 0", 35, "dosage"), ("n_ranges > 0", 15, "numbers"), ("n_polarity > 0", 20, "pos_neg"), ("n_course > 0", 15, "acute_chron"), ("n_direction > 0", 20, "directions"), ("n_diagnosis > 0", 15, "diagnosis"),
    ("n_treatment > 0", 25, "treatment"), ("n_abbr > 0", 10, "abbreviations"), ("n_lab > 0", 10, "lab_values"), ("n_procedures > 0", 8, "procedures"), ("n_medication > 0", 12, "medications"),
)


@relation("features", query=False)
def risked(d):
    """Features with the risk score, its level and reasons."""
    score = " + ".join(f"CASE WHEN {test} THEN {points} ELSE 0 END" for test, points, _ in RISK)
    labels = d.filter(d.array(*(f"CASE WHEN {test} THEN '{label}' END" for test, _, label in RISK)), "x IS NOT NULL")
    level = "CASE WHEN n_chars = 0 THEN 'LOW' WHEN s >= 65 THEN 'CRITICAL' WHEN s >= 35 THEN 'HIGH' WHEN s >= 12 THEN 'MEDIUM' ELSE 'LOW' END"
    return f"""SELECT b.*, CASE WHEN n_chars = 0 THEN 0 ELSE s END AS score, {level} AS level
FROM (SELECT a.*, least(100, CASE WHEN n_words <= 3 AND raw < 20 THEN greatest(raw, 5) ELSE raw END) AS s FROM (SELECT f.*, {score} AS raw, {d.join(labels, ',')} AS reasons FROM features f) a) b"""


@relation("risked")
def risk_score(d):
    return "SELECT id, score, level, reasons, level IN ('HIGH', 'CRITICAL') AND (contains(reasons, 'dosage') OR contains(reasons, 'numbers')) AS needs_numeric_qa FROM risked"


@relation("risk_score")
def risk_histogram_pct(d):
    return "SELECT level, count(*) AS n, round(100 * count(*) / (sum(count(*)) OVER () * 1e0), 1) AS percent FROM risk_score GROUP BY level"


@relation("risked", query=False)
def raw_scores(d):
    """Six scores, 0 to 1; caps and divisors are fixed values."""
    w, ten = "greatest(n_words, 1)", "greatest(n_words / 1e1, 1e0)"
    return f"""SELECT f.*,
CASE WHEN length(source_text) < 5 THEN 0e0 ELSE least(1e0, least(4e-1, n_roots / ({w} * 1e0)) + least(35e-2, n_abbr / ({w} * 1e0)) + least(15e-2, n_initials / {ten}) + least(1e-1, n_units / {ten})) END AS density_raw,
least(1e0, least(4e-1, n_roots / ({w} / 2e0)) + least(25e-2, n_suffixes / ({w} / 2e0)) + least(15e-2, n_caps / {ten}) + least(2e-1, (n_diagnosis + n_treatment + n_procedures + n_medication) / 1e1)) AS medicality_raw,
least(1e0, least(5e-1, {' + '.join(f'CASE WHEN {t} THEN 1 ELSE 0 END' for t, _, _ in RISK)} / 8e0) + least(25e-2, n_caps / {ten}) + least(15e-2, (n_separators + n_parens) / {ten}) + least(1e-1, n_logic / 3e0)) AS entity_raw,
least(1e0, least(3e-1, n_numbers / greatest(n_words / 5e0, 1e0)) + least(25e-2, n_short_caps / {ten}) + least(2e-1, n_marks / 1e1) + CASE WHEN n_pipes > 0 THEN 15e-2 ELSE 0e0 END + CASE WHEN n_nested > 0 THEN 1e-1 ELSE 0e0 END + least(15e-2, n_logic / 3e0)) AS reversibility_raw,
least(1e0, CASE level WHEN 'CRITICAL' THEN 95e-2 WHEN 'HIGH' THEN 65e-2 WHEN 'MEDIUM' THEN 35e-2 WHEN 'LOW' THEN 5e-2 ELSE 5e-1 END + least(2e-1, n_units * 1e-1) + least(15e-2, n_lab * 5e-2) + least(1e-1, n_danger * 5e-2)) AS criticality_raw
FROM risked f"""


@relation("raw_scores", query=False)
def scored(d):
    """Every score of a segment in one row: features, risk, the six scores
    with the confidence that plain MT is safe, and the structure scores.  It
    is one projection over segments; no score is joined back."""
    two = lambda c, hi, a, lo, b: f"CASE WHEN {c}_raw > {hi} THEN {a} WHEN {c}_raw > {lo} THEN {b} ELSE 0e0 END"
    safe = f"""1 - CASE level WHEN 'CRITICAL' THEN 95e-2 WHEN 'HIGH' THEN 6e-1 WHEN 'LOW' THEN 0e0 ELSE 25e-2 END - {two('entity', '6e-1', '35e-2', '3e-1', '15e-2')} - {two('reversibility', '6e-1', '4e-1', '3e-1', '2e-1')}
 - {two('density', '7e-1', '3e-1', '4e-1', '15e-2')} - {two('medicality', '7e-1', '25e-2', '4e-1', '1e-1')} - {two('criticality', '7e-1', '5e-1', '4e-1', '25e-2')}"""
    six = ", ".join(f"round({c}_raw, 3) AS {c}" for c in ("density", "medicality", "entity", "reversibility", "criticality"))
    return d.settled(f"SELECT r.*, {six}, round(CASE WHEN n_chars < 5 THEN 0e0 ELSE greatest(0e0, least(1e0, {safe})) END, 3) AS safe_confidence, {structure(d)} FROM raw_scores r")


@relation("scored")
def semantic_scores(d):
    """The six scores with the confidence that plain MT is safe."""
    return "SELECT id, level, density, medicality, entity, reversibility, criticality, safe_confidence FROM scored"


def structure(d):
    """Five structure scores as columns."""
    f = lambda *parts: " + ".join(f"CASE WHEN {test} THEN {points} ELSE 0e0 END" for test, points in parts)
    author = f(("n_initials > 0", "3e-1"), ("n_initials > 1", "3e-1"), ("n_separators > 1", "2e-1"), ("n_words < 12", "2e-1"))
    affiliation = f(("n_initials > 0", "15e-2"), ("n_degrees > 0", "2e-1"), ("n_specialty > 0", "2e-1"), ("n_institution >= 2", "15e-2"), ("n_words > 4", "15e-2"), ("n_marks > 0", "1e-1"))
    institution = f(("n_specialty > 0", "25e-2"), ("n_institution > 0", "15e-2"), ("n_words > 4", "15e-2"), ("n_caps > 3", "2e-1"), ("n_parens > 0", "1e-1"))
    table = f(("n_numbers > 1", "2e-1"), ("n_units > 0", "35e-2"), ("n_ranges > 0", "2e-1"), ("n_pipes > 0", "2e-1"), ("has_breaks", "15e-2"))
    title = f(("n_words <= 8", "25e-2"), ("n_numbers = 0", "1e-1"), ("n_titles > 0", "2e-1"), ("n_specialty > 0", "15e-2"), ("capital_start AND letter_end", "1e-1"))
    return f"CASE WHEN n_degrees > 0 OR n_institution > 0 THEN 0e0 ELSE {author} END AS author, {affiliation} AS affiliation, {institution} AS institution, {table} AS tables, {title} AS title"


#: First match wins; over the columns of ``scored``.
INTENT = """CASE WHEN n_chars < 2 THEN 'metadata_simple' WHEN affiliation > 6e-1 THEN 'biography_or_affiliation' WHEN author > 5e-1 THEN 'author_list' WHEN institution > 5e-1 THEN CASE WHEN institution > 7e-1 THEN 'institution_complex' ELSE 'institution_simple' END
WHEN tables > 6e-1 THEN 'table_or_numeric' WHEN title > 5e-1 THEN CASE WHEN n_titles > 0 THEN 'figure_caption' ELSE 'medical_title' END WHEN n_chars < 50 AND n_parens = 0 AND n_marks = 0 THEN 'metadata_simple' ELSE 'medical_content' END"""


@relation("scored")
def intent_class(d):
    return f"SELECT id, {INTENT} AS intent, CASE WHEN n_words >= 2 AND n_numbers >= 2 AND n_words < 20 THEN 'table_or_numeric' WHEN n_words < 20 THEN 'metadata_simple' ELSE 'medical_content' END AS simple_intent FROM scored"
