"""The ladder of terms and phrases in any ending by force, and an import that
stops and goes on."""

import difflib
import re

from test_rules import TERMS
from test_whole import PART, bound, documents

from segq.sources.queries import term_ladder_whole
from segq.sources.shared import shared_path
from segq.streaming.queries import committed, import_once


def test_ladder_by_force(spark):
    names = ["golden ring", "ring of gold", "silver spoon", "blue", "golden rings"]
    texts = ["golden rang", "gold of a ring", "Golden Ring here", "a golden ring", "silver spoons", "spoon, silver", "blu", "the golden ring is long gone from here", ""]
    docs = documents(*enumerate(texts, 1))
    parts = PART, [(i, n, "b", "t", 1, 1.0) for i, n in enumerate(names)]
    tables = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in {"documents": docs, "nation": TERMS["nation"], "part": parts}.items()}
    got = {(r.id, r.term): (r.match_type, r.score) for r in term_ladder_whole(spark, tables).collect()}
    terms = {n.split()[0] for n in names} | {"france", "the", "that", "with", "dans", "pour", "nicht", "para", "of the", "and the"}
    words = lambda t: set(re.findall(r"[^\W_]{2,}", t.lower()))
    plain = lambda t: re.sub(r"[^\w\s]", "", t.lower()).strip()
    want = {}
    for i, text in enumerate(texts, 1):
        for term in terms:
            if not words(term) & words(text):
                continue
            if term in text:
                want[i, term] = ("exact", 1.0)
            elif term in text.lower():
                want[i, term] = ("case_insensitive", 0.98)
            elif difflib.SequenceMatcher(None, plain(term), plain(text[: 3 * len(term)]), autojunk=False).ratio() >= 0.72:
                want[i, term] = ("fuzzy", 0.72)
            elif words(term) <= words(text):
                want[i, term] = ("partial", 0.85)
    assert got == want


def test_fuzzy_rung_comes_after_the_exact_ones(spark):
    docs = documents((1, "of a the"), (2, "OF THE"), (3, "of tha"), (4, "the end of it"))
    tables = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in {"documents": docs, **TERMS}.items()}
    got = {(r.id, r.term): r.match_type for r in term_ladder_whole(spark, tables).collect()}
    assert got[1, "of the"] == "fuzzy" and got[2, "of the"] == "case_insensitive" and got[3, "of the"] == "fuzzy" and got[4, "of the"] == "partial"


def stem_by_force(term, text):
    low = text.lower()
    if term in low:
        return term
    parts = [re.escape(w[: max(4, int(len(w) * 0.75))]) + r"[^\W\d_]*" for w in term.split()]
    m = re.search(r"(?<![^\W\d_])(" + r"[ \t\n\r\f]+".join(parts) + ")", low)
    return m[1] if m else None


def test_phrases_in_any_ending(spark):
    texts = ["of theory", "often there is", "nichts", "x of\n the", "ringe ofthe", "para-medic", "PARAS", "dans", "andrew thematic", "and these things", "France's", "frances and francais", "unnicht", "", "with", "wither with"]
    docs = documents(*enumerate(texts, 1))
    got = {(r.id, r.term): r.form for r in bound(spark, "term_stem", documents=docs, **TERMS)}
    terms = ["the", "that", "with", "dans", "pour", "nicht", "para", "of the", "and the", "france", "ring"]
    want = {(i, t): f for i, x in enumerate(texts, 1) for t in terms if (f := stem_by_force(t, x)) is not None}
    assert got == want and (9, "and the") in want and (2, "of the") in want


def test_import_stops_and_goes_on(spark):
    base = shared_path(spark, "import")
    schema = "doc_id long, text string"
    parts = [[(1, "One text"), (2, "two"), (3, None)], [(4, " one  TEXT "), (5, "three"), (6, "   ")], [(7, "two"), (8, "four"), (9, "three")]]
    sink, checkpoint = f"{base}/sink", f"{base}/checkpoint"
    for k, rows in enumerate(parts[:2]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/part{k}")
    import_once(spark, f"{base}/in/*", schema, sink, checkpoint, per_run=1)
    assert len(committed(spark, sink)) == 2
    spark.createDataFrame(parts[2], schema).coalesce(1).write.parquet(f"{base}/in/part2")
    got = import_once(spark, f"{base}/in/*", schema, sink, checkpoint, per_run=1)
    again = import_once(spark, f"{base}/in/*", schema, sink, checkpoint, per_run=1)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in again.collect()) == [1, 2, 5, 8]
