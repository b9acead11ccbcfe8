"""Joins by edit distance and by containment that lose no pair.

``edit_pairs``: texts a and b with 1 - levenshtein / longer length >= ratio.
An edit changes q q-grams at most, so with padded texts two such texts share
max + q - 1 - q * (1 - ratio) * max grams or more, which is at least one as q
is half of 1 / (1 - ratio).  Each text's grams are put in one global order,
rare ones first, and a text of n characters offers only the first of them that
leave fewer than it must share; two texts with enough in common then meet on a
gram.  Repeated grams are numbered.  Lengths must agree as the ratio asks: a
gram is joined inside geometric bands of length, and a text stands in its own
band and, on the right, in the next two.

``contained_pairs``: a inside b.  At most ``FEW`` left texts are looked for in
each right text as it is read, and nothing is shuffled.  Of more, the left text
offers one gram, its rarest of three characters (or itself, if shorter); the
right one all of its grams.

``phrase_pairs``: the words of a stand in b in a row.  The left text offers its
rarest word.

A frequent gram or word is dealt to as many slots as its number of texts asks for, so
no gram's texts meet in one task.  Pairs come out distinct and are verified on
the whole texts.  DuckDB's side of both is all pairs.
"""

from math import floor, log

#: Texts of a gram in one slot.
SLOT = 2048
#: Texts that are looked for one by one in each row of the other side.
FEW = 256
WORDS_OF, WORD = "lower(coalesce(t, ''))", r"[\p{L}\p{N}_]+"


def gram_size(ratio: float) -> int:
    return max(1, floor(0.5 / (1 - ratio) + 1e-9))


def _dealt(left: str, right: str, on: str, length: str) -> str:
    """Distinct (a_id, b_id) of rows (id, key, slots, ...) that share a key."""
    return f"""SELECT DISTINCT l.id AS a_id, r.id AS b_id FROM (SELECT *, CAST(pmod(xxhash64(id), slots) AS INT) AS slot FROM ({left}) x) l
JOIN (SELECT *, explode(sequence(0, slots - 1)) AS slot FROM ({right}) y) r ON l.key = r.key AND l.slot = r.slot AND {on} WHERE {length}"""


def edit_pairs(d, left: str, right: str, ratio: float) -> str:
    """SELECT a_id, a_t, b_id, b_t, similarity over relations (id, t) with
    distinct ids; empty texts are in no pair."""
    similar = "1 - levenshtein(a.t, b.t) / (greatest(length(a.t), length(b.t)) * 1e0)"
    sides = f"least(length(a.t), length(b.t)) >= {ratio}e0 * greatest(length(a.t), length(b.t))"
    if d.name == "duck":
        return f"SELECT a.id AS a_id, a.t AS a_t, b.id AS b_id, b.t AS b_t, {similar} AS similarity FROM (SELECT * FROM {left} WHERE t <> '') a, (SELECT * FROM {right} WHERE t <> '') b WHERE {sides} AND {similar} >= {ratio}e0"
    q = gram_size(ratio)
    must = f"greatest(1, ceil(n * (1 - {q} * (1 - {ratio}e0)) - 1e-6) + {q - 1})"
    base = log(1 / ratio)

    def grams(rel: str) -> str:
        padded = f"repeat(chr(1), {q - 1}) || t || repeat(chr(2), {q - 1})"
        cut = f"SELECT id, length(t) AS n, posexplode(transform(sequence(1, length(t) + {q - 1}), i -> substring({padded}, i, {q}))) AS (pos, gram) FROM {rel} WHERE t <> ''"
        return f"SELECT id, n, gram || ':' || row_number() OVER (PARTITION BY id, gram ORDER BY pos) AS key FROM ({cut}) c"

    both = grams(left) if left == right else f"{grams(left)} UNION ALL {grams(right)}"
    counts = f"SELECT key, count(*) AS c FROM ({both}) u GROUP BY key"

    def offered(rel: str) -> str:
        ranked = f"SELECT g.id, g.n, g.key, k.c, row_number() OVER (PARTITION BY g.id ORDER BY k.c, g.key) AS rn FROM ({grams(rel)}) g JOIN ({counts}) k ON g.key = k.key"
        return f"SELECT id, n, key, CAST(ceil(c / {SLOT}e0) AS INT) AS slots, CAST(floor(ln(n) / {base}) AS INT) AS own FROM ({ranked}) p WHERE rn <= n + {q - 1} - {must} + 1"

    # Lengths of a pair differ by one band of the logarithm at most; the others guard the rounding at its edges.
    bands = lambda rel: f"SELECT *, explode(array(own - 2, own - 1, own, own + 1, own + 2)) AS band FROM ({offered(rel)}) o"
    near = f"least(l.n, r.n) >= {ratio}e0 * greatest(l.n, r.n)"
    pairs = _dealt(f"SELECT *, own AS band FROM ({offered(left)}) o", bands(right), "l.band = r.band", near)
    return f"SELECT a_id, a_t, b_id, b_t, similarity FROM (SELECT p.a_id, a.t AS a_t, p.b_id, b.t AS b_t, {similar} AS similarity FROM ({pairs}) p JOIN {left} a ON p.a_id = a.id JOIN {right} b ON p.b_id = b.id) v WHERE similarity >= {ratio}e0"


def few(rel: str, row: str) -> str:
    """Array of ``row`` (a struct) of the relation's rows with a text if they
    are ``FEW`` at most, else null; never more than one beyond that are held."""
    return f"(SELECT CASE WHEN count(*) <= {FEW} THEN collect_list(r) END FROM (SELECT {row} AS r FROM {rel} WHERE t <> '' LIMIT {FEW + 1}) f)"


def many(rel: str) -> str:
    """Whether the relation has more texts than ``few`` takes."""
    return f"(SELECT count(*) FROM (SELECT 1 AS one FROM {rel} WHERE t <> '' LIMIT {FEW + 1}) f) > {FEW}"


def contained_pairs(d, left: str, right: str) -> str:
    """SELECT a_id, a_t, b_id, b_t where the left text stands in the right."""
    if d.name == "duck":
        return f"SELECT a.id AS a_id, a.t AS a_t, b.id AS b_id, b.t AS b_t FROM {left} a, {right} b WHERE a.t <> '' AND contains(b.t, a.t)"
    row = few(left, "struct(id AS a_id, t AS a_t)")
    each = f"SELECT h.a_id, h.a_t, b_id, b_t FROM (SELECT id AS b_id, t AS b_t, explode(filter(asked, x -> contains(t, x.a_t))) AS h FROM (SELECT *, {row} AS asked FROM {right}) a) e"
    gram = lambda k: "concat(" + ", ".join(f"element_at(c, i + {j})" for j in range(k)) + ")"
    cut = lambda rel, k: f"SELECT id, explode(transform(sequence(1, size(c) - {k - 1}), i -> {gram(k)})) AS key FROM (SELECT id, split(t, '') AS c FROM {rel} WHERE length(t) >= {k}) x"
    own = f"SELECT DISTINCT id, key FROM ({cut(left, 3)} UNION ALL SELECT id, t AS key FROM {left} WHERE length(t) BETWEEN 1 AND 2) w"
    # Only grams that a left text has are kept, before anything is shuffled by them.
    every = " UNION ALL ".join(cut(f"(SELECT * FROM {right} WHERE {many(left)})", k) for k in (1, 2, 3))
    grams = f"SELECT DISTINCT g.id, g.key FROM ({every}) g LEFT SEMI JOIN (SELECT DISTINCT key FROM ({own}) q) q ON g.key = q.key"
    counts = f"SELECT key, count(*) AS c FROM ({grams}) g GROUP BY key"
    rarest = f"SELECT o.id, min_by(o.key, struct(k.c, o.key)) AS key, min(k.c) AS c FROM ({own}) o JOIN ({counts}) k ON o.key = k.key GROUP BY o.id"
    slots = f"CAST(ceil(c / {SLOT}e0) AS INT) AS slots"
    pairs = _dealt(f"SELECT r.id AS id, key, {slots} FROM ({rarest}) r", f"SELECT g.id, g.key, {slots} FROM ({grams}) g JOIN ({counts}) k ON g.key = k.key", "true", "true")
    return f"{each} UNION ALL SELECT a_id, a_t, b_id, b_t FROM (SELECT p.a_id, a.t AS a_t, p.b_id, b.t AS b_t FROM ({pairs}) p JOIN {left} a ON p.a_id = a.id JOIN (SELECT * FROM {right} WHERE {many(left)}) b ON p.b_id = b.id) v WHERE contains(b_t, a_t)"


def phrase_pairs(d, terms: str, texts: str) -> str:
    """SELECT a_id, a_t, b_id, b_t where the term's words stand in the text as
    a phrase, case folded."""
    both = "contains(b.padded, a.padded)"
    shown = lambda rel: f"SELECT id, t, {d.padded('t')} AS padded FROM {rel}"
    if d.name == "duck":
        return f"SELECT a.id AS a_id, a.t AS a_t, b.id AS b_id, b.t AS b_t FROM ({shown(terms)}) a, ({shown(texts)}) b WHERE a.padded <> '  ' AND {both}"
    words = lambda rel: f"SELECT id, explode(array_distinct({d.all(WORDS_OF, WORD)})) AS key FROM {rel}"
    asked = f"SELECT DISTINCT key FROM ({words(terms)}) w"
    held = f"SELECT x.id, x.key FROM ({words(texts)}) x LEFT SEMI JOIN ({asked}) q ON x.key = q.key"
    counts = f"SELECT key, count(*) AS c FROM ({held}) h GROUP BY key"
    rarest = f"SELECT o.id, min_by(o.key, struct(k.c, o.key)) AS key, min(k.c) AS c FROM ({words(terms)}) o JOIN ({counts}) k ON o.key = k.key GROUP BY o.id"
    slots = f"CAST(ceil(c / {SLOT}e0) AS INT) AS slots"
    pairs = _dealt(f"SELECT r.id AS id, key, {slots} FROM ({rarest}) r", f"SELECT g.id, g.key, {slots} FROM ({held}) g JOIN ({counts}) k ON g.key = k.key", "true", "true")
    return f"SELECT p.a_id, a.t AS a_t, p.b_id, b.t AS b_t FROM ({pairs}) p JOIN ({shown(terms)}) a ON p.a_id = a.id JOIN ({shown(texts)}) b ON p.b_id = b.id WHERE {both}"
