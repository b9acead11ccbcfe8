"""Readers and writers: docx, tsv, tmx, json state, paste text.

All readers have explicit schemas; documents in zip containers are parsed one
file a row on the executors, writers use Spark's committers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, block_type string, block_index int, text string"


def docx_blocks(data: bytes) -> Iterator[tuple[str, int, str]]:
    """Body paragraphs first, then paragraphs of table cells; blanks skipped."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    cells = {id(p) for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    index = 0
    for kind in ("paragraph", "table_cell"):
        for p in root.iter(f"{W}p"):
            if (id(p) in cells) == (kind == "table_cell"):
                text = re.sub(r"\s+", " ", "".join(t.text or "" for t in p.iter(f"{W}t"))).strip()
                if text:
                    yield kind, index, text
                    index += 1


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches):
        for pdf in batches:
            rows = [(p, *b) for p, c in zip(pdf["path"], pdf["content"]) for b in docx_blocks(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "block_type", "block_index", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, BLOCKS)


def import_segments(blocks: DataFrame) -> DataFrame:
    """Segments in order per file, status new."""
    return blocks.select("path", (F.col("block_index") + 1).alias("segment_order"), "block_type", F.col("text").alias("source_text"), F.lit("new").alias("status"))


def docx_bytes(template: bytes, texts: list[str]) -> bytes:
    """The template with its blocks' texts replaced in order: the first run of
    a paragraph takes the text, the others are blanked."""
    src, out = zipfile.ZipFile(io.BytesIO(template)), io.BytesIO()
    root = ElementTree.fromstring(src.read("word/document.xml"))
    cells = {id(p) for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    left = iter(texts)
    for in_table in (False, True):
        for p in root.iter(f"{W}p"):
            runs = list(p.iter(f"{W}t"))
            if (id(p) in cells) == in_table and "".join(t.text or "" for t in runs).strip():
                put = next(left, None)
                if put is not None:
                    runs[0].text = put
                    for t in runs[1:]:
                        t.text = ""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in src.namelist():
            z.writestr(item, ElementTree.tostring(root) if item == "word/document.xml" else src.read(item))
    return out.getvalue()


def export_docx(templates: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, content): each file with its translations, else the source."""

    def build(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = right.sort_values("segment_order")["text"].tolist()
        return pd.DataFrame({"path": [key[0]] * len(left), "content": [docx_bytes(bytes(c), texts) for c in left["content"]]})

    rows = segments.select("path", "segment_order", F.coalesce("target_text", "source_text", F.lit("")).alias("text"))
    return templates.select("path", "content").groupBy("path").cogroup(rows.groupBy("path")).applyInPandas(build, "path string, content binary")


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header tsv; values trimmed, missing is '', rows with two values stay."""
    df = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in columns), encoding="UTF-8")
    df = df.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns))
    return df.filter(F.size(F.filter(F.array(*columns), lambda x: x != "")) >= 2)


def write_tsv(df: DataFrame, path: str, sort_by: str) -> None:
    """Sorted tsv (range-partitioned files; their order is the sort order)."""
    df.orderBy(F.lower(sort_by), sort_by).write.csv(path, sep="\t", header=True, mode="overwrite")


TMX = """<?xml version="1.0" encoding="UTF-8"?>
<tmx version="1.4"><header creationtool="segq" creationtoolversion="1" segtype="sentence" o-tmf="segq" adminlang="en" srclang="{0}" datatype="plaintext" creationdate="{1}"/><body>"""


def escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_tmx(df: DataFrame, path: str, source: str, target: str, source_lang: str = "ru", target_lang: str = "en", created: str = "20260101T000000Z") -> None:
    """TMX 1.4: every partition becomes a whole document with header and body,
    a unit a line; empty partitions write none."""
    side = lambda lang, c: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), escaped(F.coalesce(F.col(c), F.lit(""))), F.lit("</seg></tuv>"))
    units = df.select(F.concat(F.lit("<tu>"), side(source_lang, source), side(target_lang, target), F.lit("</tu>")).alias("value"))

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for pdf in batches:
            if len(pdf):
                yield pd.concat([pd.DataFrame({"value": [TMX.format(source_lang, created)]}), pdf]) if not begun else pdf
                begun = True
        if begun:
            yield pd.DataFrame({"value": ["</body></tmx>"]})

    units.mapInPandas(document, "value string").write.mode("overwrite").text(path)


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    schema = "tuv array<struct<`_xml:lang`: string, seg: string>>"
    rows = spark.read.format("xml").options(rowTag="tu").schema(schema).load(path)
    return rows.select(F.col("tuv")[0]["seg"].alias("source_text"), F.col("tuv")[1]["seg"].alias("target_text"))


SHEET, MAIN = "xl/worksheets/sheet1.xml", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Cell texts of the first sheet, row by row; blanks are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    for row in ElementTree.fromstring(z.read(SHEET)).iter(f"{MAIN}row"):
        cells = []
        for c in row.iter(f"{MAIN}c"):
            v = c.findtext(f"{MAIN}v")
            text = shared[int(v)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{MAIN}t")) or v
            if text:
                cells.append(text)
        yield cells


def read_xlsx_pairs(spark: SparkSession, path: str, longest: int = 120) -> DataFrame:
    """(path, ru, en): the first two cells of each row, each of bounded length,
    oriented by script."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                for cells in sheet_rows(bytes(content)):
                    if len(cells) >= 2 and max(map(len, cells[:2])) <= longest:
                        a, b = (x.strip() for x in cells[:2])
                        swap = len(re.findall("[\u0400-\u04ff]", b)) > len(re.findall("[\u0400-\u04ff]", a))
                        rows.append((p, b, a) if swap else (p, a, b))
            yield pd.DataFrame(rows, columns=["path", "ru", "en"]).astype(str)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, ru string, en string")


def first_path(spark: SparkSession, *paths: str) -> str:
    """The first path that Spark can list; else an error that names all."""
    for path in paths:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


REPORT = ("id", "project", "status", "route", "risk", "source_preview", "target_preview", "qa_status", "score")


def write_report(df: DataFrame, path: str) -> None:
    """The nine-column report as csv: rows with a text, previews of 50."""
    rows = df.filter(F.col("status").isin("translated", "confirmed"))
    rows = rows.withColumn("source_preview", F.substring("source_text", 1, 50)).withColumn("target_preview", F.substring("target_text", 1, 50))
    rows.select(*REPORT).write.mode("overwrite").csv(path, header=True)


STATE = "projects array<struct<id: long, title: string, src: string, tgt: string, segments: array<struct<id: long, source: string, target: string, status: string, risk: string>>>>, glossary array<struct<src: string, tgt: string, cat: string>>, tm array<struct<src: string, tgt: string, quality: string, verified: boolean>>"


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The JSON document as frames; old rows migrate: verified -> quality."""
    state = spark.read.schema(STATE).json(path, multiLine=True)
    segments = state.select(F.explode("projects").alias("p")).select(F.col("p.id").alias("project_id"), F.explode("p.segments").alias("s")).select("project_id", "s.*")
    tm = state.select(F.inline("tm")).withColumn("quality", F.coalesce("quality", F.when(F.col("verified"), "verified").otherwise("draft"))).drop("verified")
    return {"segments": segments, "glossary": state.select(F.inline("glossary")), "tm": tm}
