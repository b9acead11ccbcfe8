"""Text cleaning, verdicts and dictionary parsing."""

from segq.functions import lexicons as L
from segq.plans.core import relation


@relation("segments")
def text_clean(d):
    """Entities of the five common names, control characters, white space."""
    t = "source_text"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    t = d.sub(t, "[\\x00-\\x08\\x0e-\\x1f\\x7f]+", "")
    return f"SELECT id, {d.sha('trim(' + d.sub(t, '[ \\t\\n\\x0b\\f\\r]+', ' ') + ')')} AS clean_hash FROM segments"


@relation("segments")
def ocr_garbage(d):
    """Digits inside words, or 40% of the longer words without a vowel."""
    long_ = d.filter(d.tokens("source_text"), "length(x) >= 5")
    bad = d.filter(d.tokens("source_text"), "length(x) >= 5 AND NOT " + d.has("x", "[aeiouyàáâäèéêëìíîïòóôöùúûü]"))
    return f"SELECT id, {d.size(long_)} AS long_words, {d.size(bad)} AS bad_words, {d.has('source_text', '[a-z][0-9]+[a-z]')} OR ({d.size(long_)} > 0 AND {d.size(bad)} >= 4e-1 * {d.size(long_)}) AS is_garbage FROM segments"


@relation("segments")
def script_ratios(d):
    letters, latin, cyr = d.n("source_text", "[\\p{L}]"), d.n("source_text", "[A-Za-z]"), d.n("source_text", "[\\p{Cyrillic}]") if d.name == "duck" else d.n("source_text", "[\\p{IsCyrillic}]")
    return f"SELECT id, CASE WHEN {letters} = 0 THEN 0e0 ELSE round({latin} / ({letters} * 1e0), 4) END AS latin_ratio, CASE WHEN {letters} = 0 THEN 'unknown' WHEN {cyr} > 25e-2 * {letters} THEN 'ru' ELSE 'en' END AS detected FROM segments"


@relation("segments", query=False)
def lines(d):
    return f"SELECT id, CAST(pos AS BIGINT) AS pos, x AS line FROM (SELECT id, {d.posexplode(d.split('source_text', chr(10)) if d.name == 'spark' else 'string_split(source_text, chr(10))')} FROM segments) t"


@relation("lines")
def dict_parse_carry_forward(d):
    """A short line without a full stop heads the lines that follow it."""
    head = f"CASE WHEN length(line) < 60 AND NOT {d.ends('line', "'.'")} THEN substring(line, 1, 60) END"
    return f"SELECT id, pos, coalesce({d.last_known(head, 'PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}, '') AS headword, length(line) AS n FROM lines"


@relation("lines")
def hyphen_join(d):
    """A line that ends in a hyphen, soft or plain, loses it and takes the next
    line on, which is then used up: in a run of such lines the first, third and
    so on take their follower."""
    w = "(PARTITION BY id ORDER BY pos)"
    soft = f"({d.ends('line', 'chr(173)')} OR {d.ends('line', "'-'")})"
    place = f"pos - coalesce(max(CASE WHEN NOT soft THEN pos END) OVER {w}, -1)"
    takes = "soft AND place % 2 = 1"
    return f"""SELECT id, pos, CASE WHEN {takes} THEN substring(line, 1, length(line) - 1) || coalesce(ltrim(following), '') ELSE line END AS joined
FROM (SELECT *, coalesce(lag({takes}) OVER {w}, false) AS used FROM (SELECT *, {place} AS place, lead(line) OVER {w} AS following FROM (SELECT id, pos, line, {soft} AS soft FROM lines) s) p) t WHERE NOT used"""


@relation("lines")
def see_ref_filter(d):
    ref = d.has("line", "^[Ss]ee( also)? ") + " OR " + d.has("line", "^[Ll]icensed under ")
    return f"SELECT id, count(*) AS n_lines, count_if({ref}) AS n_refs FROM lines GROUP BY id"


@relation("lines")
def noise_lines(d):
    return f"SELECT id, count_if(NOT ({d.has('line', '^[0-9 .,;:|-]*$')} OR length(line) < 3)) AS kept, count(*) AS n FROM lines GROUP BY id"


@relation("segments")
def tm_contamination(d):
    return f"SELECT id, CASE WHEN length(source_text) < 20 THEN 'short' WHEN {d.has('source_text', '[A-Z]{8,}')} THEN 'heading' WHEN {d.n('source_text', '[^\\p{L} ]')} > 3e-1 * length(source_text) THEN 'symbols' END AS reason FROM segments"


@relation("segments")
def paste_import(d):
    """First '|' splits a line, else the first tab, else the row is skipped."""
    sep = "CASE WHEN contains(source_text, '|') THEN instr(source_text, '|') WHEN contains(source_text, chr(9)) THEN instr(source_text, chr(9)) ELSE 0 END"
    return f"SELECT id, trim(substring(source_text, 1, p - 1)) AS left_part, length(substring(source_text, p + 1)) AS right_length FROM (SELECT id, source_text, {sep} AS p FROM segments) t WHERE p > 0"


@relation("segments")
def number_units(d):
    unit = "[0-9] ?(" + "|".join(L.UNITS) + ")"
    return f"SELECT id, {d.size(d.all('source_text', '[0-9]+([.,][0-9]+)?'))} AS n_numbers, {d.join(d.sort(d.distinct(d.all('lower(source_text)', unit))), ',')} AS units FROM segments"


@relation("segments")
def xml_escape(d):
    t = "source_text"
    for a, b in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'\"'", "&quot;"), ("chr(39)", "&apos;")):
        t = f"replace({t}, {a}, '{b}')"
    return f"SELECT id, {t} AS escaped FROM segments"
