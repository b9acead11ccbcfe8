"""The nested state over the tables: documents are segments, parts are terms;
and documents in workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from segq.sources import sheets
from segq.sources import state as S
from segq.sources.shared import shared_path

#: Segments or terms of one document of the older form.
DOC = 100


def _legacy(spark, sf_dir, small: bool):
    """A folder of documents in the older form.  Documents of the table are
    segments of seven projects by their id; terms and memory are parts, and a
    small glossary is the nations."""
    status = "CASE pmod(floor(doc_id / 7), 6) WHEN 0 THEN 'new' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'failed' WHEN 3 THEN 'review' WHEN 4 THEN 'translated' ELSE 'qa' END"
    one = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "n_chars")).alias("d"))
    one = one.select("doc_id", "d.*").withColumn("status", F.expr(status))
    segment = F.struct(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.expr("CASE WHEN status <> 'new' THEN lang ELSE '' END").alias("target"), "status",
                       F.expr("CASE WHEN n_chars > 4000 THEN 'critical' WHEN n_chars > 1000 THEN 'high' WHEN n_chars > 300 THEN 'medium' ELSE 'low' END").alias("risk"))
    project = one.groupBy(F.expr("pmod(doc_id, 7)").alias("id"), F.floor(F.col("doc_id") / DOC).alias("document")).agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    project = project.select("document", F.array(F.struct("id", F.concat(F.lit("project "), F.col("id")).alias("title"), F.lit("RU").alias("src"), F.lit("EN").alias("tgt"), "segments")).alias("projects"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey is not null")
    block = F.floor(F.col("p_partkey") / DOC).alias("document")
    memory = F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("src"), F.col("p_type").alias("tgt"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'checked' END").alias("quality"), F.expr("p_size > 25").alias("verified"))
    tm = part.groupBy(block).agg(F.transform(F.sort_array(F.collect_list(memory)), lambda x: x.dropFields("k")).alias("tm"))
    if small:
        terms = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("src"), F.lit("seed").alias("tgt"))
    else:
        terms = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("src"), F.col("p_type").alias("tgt"), F.col("p_brand").alias("cat"), F.col("p_size").cast("long").alias("freq"), F.lit("Medium").alias("conf"))
    entry = F.struct("k", *(c for c in S.TERM if c in terms.columns))
    glossary = terms.groupBy(F.floor(F.col("k") / DOC).alias("document")).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x.dropFields("k")).alias("glossary"))
    path = shared_path(spark, "legacy")
    for docs in (project, tm, glossary):
        docs.write.mode("append").json(path, compression="gzip")
    return path


def _full(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_name").alias("src"), F.col("p_type").alias("tgt"), F.col("p_brand").alias("cat"), F.col("p_size").cast("long").alias("freq"), F.lit("Medium").alias("conf"), F.col("p_partkey").alias("pos"))


def _saved(spark, sf_dir, small=False):
    """Loaded from the older form, migrated, saved and loaded again."""
    path = shared_path(spark, "state")
    S.save(spark, S.from_documents(spark, _legacy(spark, sf_dir, small), _full(spark, sf_dir), multiline=False), path)
    return path, S.load(spark, path)


def _changed(spark, sf_dir):
    """Segments patched by their labels, toxic ones reverted, saved as a second
    version."""
    path, state = _saved(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    key = (F.expr("pmod(doc_id, 7)").alias("project_id"), F.col("doc_id").alias("id"))
    patches = labels.select(
        *key, F.lit(1).alias("seq"), F.expr("CASE WHEN quality = 1 THEN 'checked' ELSE ' ' END").alias("target"), F.expr("CASE WHEN quality = 1 AND toxic = 1 THEN 'confirmed' END").alias("status"),
        F.lit("rater").alias("author"), F.expr("CASE WHEN toxic = 1 THEN 'toxic' END").alias("comment"),
    )
    state = S.revert_segments(S.update_segments(state, patches), labels.filter("toxic = 1").select(*key))
    S.save(spark, state, path)
    return S.load(spark, path)


def state_segments(spark, sf_dir):
    rows = S.segments(_changed(spark, sf_dir))
    return rows.select("project_id", "id", F.md5("source").alias("source_md5"), "target", "status", "risk", F.array_join(F.transform("comments", lambda c: F.concat(c["author"], F.lit(": "), c["text"])), "; ").alias("notes"))


def state_board(spark, sf_dir):
    return S.board(_changed(spark, sf_dir))


def state_glossary(spark, sf_dir):
    """Requests for terms, the deletion of some, and what is left in order."""
    path, state = _saved(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    requests = part.filter("p_size <= 10").select(
        F.expr("CASE WHEN p_size <= 2 THEN concat('new ', p_name) ELSE p_name END").alias("src"), F.col("p_brand").alias("tgt"), F.lit("asked").alias("cat"),
        F.lit(0).cast("long").alias("freq"), F.lit("High").alias("conf"), F.expr("p_size <= 5").alias("is_new"), F.col("p_partkey").alias("seq"),
    )
    state = S.without(S.save_terms(state, requests), "glossary", part.filter("p_size = 50").select("p_name"), "src")
    S.save(spark, state, path)
    return S.load(spark, path).glossary


def state_memory(spark, sf_dir):
    return _saved(spark, sf_dir)[1].tm


def state_seed(spark, sf_dir):
    """The glossary of the seed dump; the saved one was small and gave way."""
    return S.seed_dump(_saved(spark, sf_dir, small=True)[1]).glossary.select("src", "tgt", "cat", "freq", "pos")


def xlsx_round_trip(spark, sf_dir):
    """Whole documents in workbooks of bounded size, and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars", "text")
    books = spark.read.parquet(sheets.write_workbooks(docs, shared_path(spark, "books"), sort_by=["doc_id"]))
    rows = sheets.read_workbooks(books, "doc_id long, lang string, n_chars long, text string")
    return rows.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


def queries():
    return {f.__name__: f for f in (xlsx_round_trip, state_segments, state_board, state_glossary, state_memory, state_seed)}


CHANGED = """WITH s AS (SELECT doc_id, doc_id % 7 AS project_id, md5(text) AS source_md5, lang,
list_extract(['new', 'confirmed', 'failed', 'review', 'translated', 'qa'], CAST(doc_id // 7 % 6 AS INT) + 1) AS was,
CASE WHEN n_chars > 4000 THEN 'critical' WHEN n_chars > 1000 THEN 'high' WHEN n_chars > 300 THEN 'medium' ELSE 'low' END AS risk FROM documents),
p AS (SELECT s.*, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled,
CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'confirmed' WHEN l.quality = 1 AND was = 'new' THEN 'translated' ELSE was END AS patched,
CASE WHEN l.doc_id IS NULL THEN CASE WHEN was = 'new' THEN '' ELSE lang END WHEN l.quality = 1 THEN 'checked' ELSE ' ' END AS put FROM s LEFT JOIN labels l ON s.doc_id = l.doc_id),
c AS (SELECT project_id, doc_id AS id, source_md5, CASE WHEN toxic = 1 AND patched = 'failed' THEN '' ELSE put END AS target,
CASE WHEN toxic = 1 AND patched = 'confirmed' THEN 'translated' WHEN toxic = 1 AND patched = 'failed' THEN 'new' ELSE patched END AS status, risk,
CASE WHEN toxic = 1 THEN 'rater: toxic' WHEN labelled THEN '' END AS notes FROM p)"""


def oracle_sql():
    return {
        "xlsx_round_trip": "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents",
        "state_segments": f"{CHANGED} SELECT * FROM c",
        "state_board": f"""{CHANGED} SELECT project_id, CASE status WHEN 'review' THEN 'translated' ELSE status END AS board_column,
CASE risk WHEN 'critical' THEN 'urgent' ELSE risk END AS priority, count(*) AS cards FROM c WHERE status <> 'failed' GROUP BY ALL""",
        "state_glossary": """WITH q AS (SELECT CASE WHEN p_size <= 2 THEN 'new ' || p_name ELSE p_name END AS src, max(p_partkey) AS seq, arg_max(p_brand, p_partkey) AS brand, arg_max(p_size, p_partkey) AS size FROM part WHERE p_size <= 10 GROUP BY 1),
f AS (SELECT p_name AS src, min(p_partkey) AS first FROM part GROUP BY p_name),
a AS (SELECT q.*, f.first FROM q LEFT JOIN f ON q.src = f.src),
g AS (SELECT p_name AS src, CASE WHEN a.src IS NULL THEN p_type ELSE brand END AS tgt, CASE WHEN a.src IS NULL THEN p_brand ELSE 'asked' END AS cat, CASE WHEN a.src IS NULL THEN p_size ELSE 0 END AS freq, CASE WHEN a.src IS NULL THEN 'Medium' ELSE 'High' END AS conf,
0 AS batch, p_partkey // 100 AS document, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS pos FROM part LEFT JOIN a ON p_name = a.src AND p_partkey = a.first AND a.size > 5
UNION ALL SELECT src, brand, 'asked', 0, 'High', 1, 0, -seq FROM a WHERE size <= 5 OR first IS NULL)
SELECT * FROM g WHERE src NOT IN (SELECT p_name FROM part WHERE p_size = 50 AND p_name IS NOT NULL)""",
        "state_memory": "SELECT p_name AS src, p_type AS tgt, CASE WHEN p_size % 2 = 0 THEN 'checked' WHEN p_size > 25 THEN 'verified' ELSE 'draft' END AS quality FROM part",
        "state_seed": "SELECT p_name AS src, p_type AS tgt, p_brand AS cat, p_size AS freq, p_partkey AS pos FROM part ORDER BY p_partkey LIMIT 150",
    }
