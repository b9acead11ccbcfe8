"""Whole results on small bound tables, with expected rows written by hand."""

from segq.plans import registry
from segq.plans.core import run


def bound(spark, name, **tables):
    registry._load()
    return run(spark, name, {t: spark.createDataFrame(rows, schema) for t, (schema, rows) in tables.items()}).collect()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts):
    return DOCS, [(i, t, "en", "s", len(t or "")) for i, t in texts]


def test_memory_holds_every_document(spark):
    docs = documents((1, "one text"), (2, "two"), (3, "One  text"), (5, "three"), (7, "Three"), (9, "alone"))
    assert sorted((r.id, r.target_text) for r in bound(spark, "tm_upsert_last", documents=docs)) == [(2, "TM:2"), (3, "TM:3"), (7, "TM:7"), (9, "TM:9")]
    got = {r.id: r.target_text for r in bound(spark, "tm_exact_prefill", documents=docs)}
    assert got == {1: "TM:3", 2: "TM:2", 3: "TM:3", 5: "TM:7", 7: "TM:7", 9: "TM:9"}
    assert bound(spark, "tm_not_exists_insert", documents=docs) == []
    assert {r.id: r.tm_score for r in bound(spark, "context", documents=docs)} == {1: 100, 2: 0, 3: 0, 5: 100, 7: 0, 9: 0}


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_every_term_row_is_on_a_side_of_the_merge(spark):
    rows = [(i, f"Name {i // 2}", f"b{i}", "t", 50 if i % 2 else 10, 1.0) for i in range(10)] + [(10, "Name x", "bx", "t", None, 1.0)]
    got = bound(spark, "glossary_merge_full_outer", part=(PART, rows))
    assert sorted(v for r in got for side in (r.main, r.recovered) for v in side.split("; ") if v) == sorted(r[2] for r in rows)
    assert {(r.ru, r.inserted) for r in got} == {(f"name {i}", False) for i in range(5)} | {("name x", True)}


def test_xml_escape_takes_whole_texts(spark):
    text = "a & b < c > d \"e\" 'f' &amp; " * 20
    got = bound(spark, "xml_escape", documents=documents((1, text), (2, None)))
    want = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
    assert {r.id: r.escaped for r in got} == {1: want, 2: ""}


def test_consistency_term_finds_phrases_and_parts_of_words(spark):
    turns = [(1, 0, "user", "Part of the text"), (1, 1, "assistant", "eins"), (2, 0, "user", "END OF THE DAY"), (2, 1, "assistant", "zwei"), (3, 0, "user", "of a withdrawal"), (3, 1, "assistant", "drei"), (4, 0, "user", "without"), (4, 1, "assistant", "vier")]
    tables = {"conversations": ("conv_id long, turn int, role string, text string", turns), "part": (PART, [(1, "ring", "b", "t", 1, 1.0)]), "nation": ("n_nationkey int, n_name string", [(1, "FRANCE")])}
    got = {r.term: (r.n_targets, r.n) for r in bound(spark, "consistency_term", **tables)}
    assert got == {"of the": (2, 2), "the": (2, 2), "with": (2, 2)}


def test_projects_without_segments_are_as_in_their_sql(spark):
    import duckdb

    customers, orders = [(1,), (2,), (3,)], [(10, 1, "F"), (11, 1, "O"), (12, 3, "O"), (13, 9, "F")]
    got = bound(spark, "project_stats", customer=("c_custkey long", customers), orders=("o_orderkey long, o_custkey long, o_orderstatus string", orders))
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT unnest([1, 2, 3]) AS c_custkey")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", orders)
    assert sorted(tuple(r) for r in got) == sorted(con.execute(registry.oracle_sql()["project_stats"]).fetchall())
    assert (2, 0, None, None) in {tuple(r) for r in got}


def test_memory_is_asked_for_its_variants_too(spark):
    part = PART, [(1, "knee", "B", "left knee", 1, 1.0), (2, "elbow", "C", "right elbow", 1, 1.0)]
    own = [(1000000001, 1), (1000000002, 2)]
    best = {(r.id, r.tm_id): (r.score, r.band) for r in bound(spark, "tm_best_fuzzy", part=part)}
    assert best == {(1, 1): (81, "low"), (2, 2): (81, "low")} | dict.fromkeys(own, (96, "medium"))
    assert sorted((r.id, r.tm_id) for r in bound(spark, "tm_top_n", part=part)) == own
    assert {r.id: r.context for r in bound(spark, "tm_context", part=part)} == {1: "left knee => B", 2: "right elbow => C", 1000000001: "left knee => B", 1000000002: "right elbow => C"}
