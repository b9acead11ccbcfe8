"""Row-wise cleaning rules of bilingual dictionaries, over term rows and
segments; every rule is one expression and works on text of any script."""

from segq.functions import lexicons as L
from segq.plans.core import relation

CYR = "[Ѐ-ӿ]"
EDGE = "[ ;,.()-]"


def trimmed(d, col, edge=EDGE):
    return d.sub(d.sub(col, f"^{edge}+", ""), f"{edge}+$", "")


@relation("segments")
def clean_variants(d):
    """Control characters out; the same with edges of punctuation trimmed."""
    bare = d.sub("source_text", "[\\x00-\\x08\\x0e-\\x1f\\x7f]+", "")
    squeezed = d.sub(bare, "[ \\t\\n\\x0b\\f\\r]+", " ")
    return f"SELECT id, {d.sha(bare)} AS bare_hash, {d.sha(trimmed(d, squeezed))} AS trimmed_hash, length({trimmed(d, squeezed)}) AS n FROM segments"


@relation("segments")
def cyrillic_ratio(d):
    c, a = d.n("source_text", CYR), d.n("source_text", "[A-Za-z]")
    return f"SELECT id, CASE WHEN {c} + {a} = 0 THEN 0e0 ELSE round({c} / (({c} + {a}) * 1e0), 4) END AS ratio FROM segments"


CLUSTER = "^[bcdfghjklmnpqrstvwxz]+"
STARTS_2, STARTS_3 = "^(bl|br|ch|cl|cr|dr|fl|fr|gl|gr|ph|pl|pr|sc|sh|sk|sl|sm|sn|sp|st|sw|th|tr|tw|wh|wr)", "^(chr|phl|phr|sch|scr|shr|spl|spr|str|thr)"


@relation("term_rows")
def word_starts(d):
    """Leading consonants of the first word, and whether they can start one:
    none or one always, two from a set, three from prefix sets, four by their
    first three, five never."""
    head = f"coalesce({d.ext('lower(ru)', f'({CLUSTER})')}, '')"
    return f"SELECT pos, head, CASE WHEN length(head) <= 1 THEN true WHEN length(head) = 2 THEN {d.has('head', STARTS_2)} WHEN length(head) <= 4 THEN {d.has('head', STARTS_3)} ELSE false END AS valid FROM (SELECT pos, {head} AS head FROM term_rows) t"


def repaired_en(d, col="en"):
    """Trailing 'word [syn]' and bracket notes dropped, typos mended, an open
    bracket closed, edges trimmed."""
    text = d.sub(d.sub(col, " [A-Za-z]+ \\[syn\\]$", ""), " ?\\[[^\\]]*\\]", "")
    for bad, good in L.TYPOS:
        text = d.sub(text, f"(^|[^A-Za-z]){bad}($|[^A-Za-z])", f"$1{good}$2")
    return trimmed(d, text, "[ ;,.-]")


@relation("term_rows")
def en_repair(d):
    fixed = repaired_en(d, "en || CASE WHEN pos % 5 = 0 THEN ' [note]' WHEN pos % 5 = 1 THEN ' teh (open' WHEN pos % 5 = 2 THEN ' word [syn]' ELSE ' ;' END")
    return f"SELECT pos, CASE WHEN {d.n('x', '[(]')} > {d.n('x', '[)]')} THEN x || ')' ELSE x END AS repaired, x <> en AS changed FROM (SELECT pos, en, {fixed} AS x FROM term_rows) t"


@relation("term_rows")
def ru_repair(d):
    """A Latin prefix before other script is dropped, brackets closed, edges
    trimmed; the log names what was done."""
    raw = "CASE WHEN pos % 4 = 0 THEN 'the слово ' || ru ELSE ru || ' (' END"
    cut = d.sub("x", "^[A-Za-z ]+(" + CYR + ")", "$1")
    return f"SELECT pos, CASE WHEN {d.n('y', '[(]')} > {d.n('y', '[)]')} THEN y || ')' ELSE y END AS repaired, CASE WHEN y <> x THEN 'prefix' WHEN {d.n('y', '[(]')} > {d.n('y', '[)]')} THEN 'bracket' ELSE '' END AS log FROM (SELECT pos, x, {cut} AS y FROM (SELECT pos, {raw} AS x FROM term_rows) t) u"


@relation("term_rows")
def adjective_test(d):
    one = f"{d.size(d.words('ru'))} = 1"
    return f"SELECT pos, {one} AND {d.has('lower(ru)', '(' + '|'.join(L.ADJECTIVES) + ')$')} AS is_adjective FROM (SELECT pos, CASE WHEN pos % 3 = 0 THEN {d.item(d.words('ru'), 1)} ELSE ru END AS ru FROM term_rows) t"


@relation("term_rows")
def artifact_ladder(d):
    """One adjective against several words is an artifact, but for commas,
    abbreviations, hyphens, short first words and a last word that is itself
    an adjective; the first step that applies is named."""
    en_words = d.size(d.words("en"))
    return f"SELECT pos, CASE WHEN {d.size(d.words('ru'))} > 1 THEN 'phrase' WHEN {en_words} < 2 THEN 'single' WHEN contains(en, ',') THEN 'comma' WHEN {d.has('en', '[A-Z]{2,}')} THEN 'abbreviation' WHEN contains(en, '-') THEN 'hyphen' WHEN {d.has('lower(en)', '(' + '|'.join(L.ADJECTIVES) + ')$')} THEN 'adjective' ELSE 'artifact' END AS step FROM (SELECT pos, {d.item(d.words('ru'), 1)} AS ru, source AS en FROM term_rows) t"


@relation("term_rows")
def headword_cleanup(d):
    """Labels, see-references, senses and brackets out; the first variant, and
    all variants."""
    raw = "'(zool.) 1. ' || ru || ' [obs]; see ' || en || ', ' || source"
    bare = d.sub(d.sub(d.sub(raw, "\\([a-z]+\\.\\) ?|\\[[^\\]]*\\]", ""), "(^|; )[0-9]+\\. ", "$1"), "; see [^,;]*", ";")
    return f"SELECT pos, trim(split_part(split_part(x, ';', 1), ',', 1)) AS first_variant, trim(x) AS all_variants FROM (SELECT pos, {bare} AS x FROM term_rows) t"


@relation("term_rows")
def en_normal(d):
    raw = "'1) Title: ' || lower(en) || ' буква'"
    return f"SELECT pos, trim({d.sub(d.sub(d.sub(raw, '^[0-9]+[).] ?', ''), '^[A-Z][a-z]+: ', ''), CYR + '+', '')}) AS en FROM term_rows"


@relation("term_rows")
def pair_validity(d):
    """First of the conjunctive rules that a pair breaks, else 'ok'."""
    rules = (
        ("empty", "trim(ru) = '' OR trim(en) = ''"), ("short", "length(ru) < 3 OR length(en) < 3"), ("long", "length(ru) > 80 OR length(en) > 80"), ("many_words", f"{d.size(d.words('en'))} > 6 OR {d.size(d.words('ru'))} > 8"), ("same", "lower(ru) = lower(en)"),
        ("tilde", "contains(ru, '~') OR contains(en, '~')"), ("digits_start", d.has("en", "^[0-9]")), ("dangling", d.has("lower(ru)", " (of|in|the|and|for)$")), ("letters", f"{d.n('ru', '[^A-Za-z ]')} * 2 > length(ru)"),
        ("single_letters", f"{d.size(d.filter(d.words('ru'), 'length(x) = 1'))} * 10 > 3 * {d.size(d.words('ru'))}"), ("unbalanced", f"{d.n('ru', '[(]')} <> {d.n('ru', '[)]')} OR {d.n('en', '[(]')} <> {d.n('en', '[)]')}"), ("spaces", "contains(ru, '  ')"), ("see", d.has("lower(ru)", "^see ")),
    )
    return "SELECT pos, CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in rules) + " ELSE 'ok' END AS verdict FROM term_rows"


@relation("term_rows")
def tilde_expansion(d):
    """A tilde takes the headword's place; with letters behind it, it joins."""
    return f"SELECT pos, replace(x, '~', head) AS expanded, {d.has('x', '~[a-z]')} AS joined FROM (SELECT pos, {d.item(d.words('ru'), 1)} AS head, CASE WHEN pos % 2 = 0 THEN '~s ' || lower(en) ELSE lower(en) || ' ~' END AS x FROM term_rows) t"


@relation("term_rows")
def short_pair_gate(d):
    """Few words, no scan artifact, no number inside."""
    singles = f"{d.size(d.filter(d.words('ru'), 'length(x) = 1'))} > 3e-1 * {d.size(d.words('ru'))}"
    artifact = f"({singles} OR contains(ru, '  ') OR {d.n('ru', '[(]')} <> {d.n('ru', '[)]')})"
    return f"SELECT pos, {artifact} AS artifact, {d.size(d.words('en'))} <= 3 AND {d.size(d.words('ru'))} <= 4 AND NOT {artifact} AND NOT {d.has('en', '[A-Za-z][0-9]+[A-Za-z]')} AS passes FROM term_rows"


@relation("term_rows")
def strip_leading_caps(d):
    return f"SELECT pos, {d.sub('x', '^([A-Z][a-z]+ )+(' + CYR + ')', '$2')} AS kept FROM (SELECT pos, 'The Name ' || CASE WHEN pos % 2 = 0 THEN 'слово' ELSE ru END AS x FROM term_rows) t"


@relation("dup_fuzzy_pairs", "distinct_texts")
def fuzzy_ratio(d):
    """Ratio of two texts on their compare forms (no punctuation), 0 to 1."""
    form = lambda c: f"trim({d.sub(c, '[^A-Za-z0-9 ]+', '')})"
    return f"SELECT a_id, b_id, round(1 - levenshtein(x, y) / (greatest(length(x), length(y), 1) * 1e0), 3) AS ratio FROM (SELECT p.a_id, p.b_id, {form('a.t')} AS x, {form('b.t')} AS y FROM dup_fuzzy_pairs p JOIN distinct_texts a ON p.a_id = a.id JOIN distinct_texts b ON p.b_id = b.id) t"
