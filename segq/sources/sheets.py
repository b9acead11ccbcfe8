"""Workbooks (xlsx) written and read by tasks.

A frame becomes many workbooks of bounded size, each with a styled header, a
frozen first row, a filter, widths after its first rows and every other row
shaded.  Workbooks are rows (path, content), which Spark writes and commits
like any others.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DoubleType, IntegerType, LongType, ShortType, StringType

from segq.sources.files import MAIN, SHEET

#: Rows and bytes of text of one workbook.
ROWS, BYTES = 100_000, 32 << 20
#: Characters of one cell: the format ends at 32,767 units of 16 bits.
CELL = 16_000
#: Rows that widths are taken from, widest column, colours.
SAMPLE, WIDEST = 300, 62
HEADER_COLOR, EVEN_COLOR = "1F4E79", "F2F7FF"

TYPES = (StringType, BooleanType, ByteType, ShortType, IntegerType, LongType, DoubleType)

#: Parts of a workbook and their types, as the format has them.
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SPACE = MAIN.strip("{}")
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _parts(sheet: str, header: str, even: str) -> dict[str, str]:
    """All parts but the sheet.  Styles: 0 plain, 1 header, 2 odd row, 3 even."""
    override = "".join(f'<Override PartName="/{part}" ContentType="{KIND}.{kind}+xml"/>' for part, kind in (("xl/workbook.xml", "sheet.main"), (SHEET, "worksheet"), ("xl/styles.xml", "styles")))
    relation = lambda n, kind, target: f'<Relationship Id="rId{n}" Type="{OFFICE}/{kind}" Target="{target}"/>'
    fill = lambda color: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{color}"/></patternFill></fill>'
    line = "".join(f'<{side} style="thin"><color rgb="FFCCCCCC"/></{side}>' for side in ("left", "right", "top", "bottom"))
    top = '<alignment vertical="top"/>'
    return {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{override}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{relation(1, "officeDocument", "xl/workbook.xml")}</Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{SPACE}" xmlns:r="{OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{relation(1, "worksheet", "worksheets/sheet1.xml")}{relation(2, "styles", "styles.xml")}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{SPACE}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font></fonts>'
        f'<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill(header)}{fill(even)}</fills><borders count="2"><border/><border>{line}</border></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf>'
        f'<xf borderId="1" applyBorder="1" applyAlignment="1">{top}</xf><xf fillId="3" borderId="1" applyFill="1" applyBorder="1" applyAlignment="1">{top}</xf></cellXfs></styleSheet>',
    }


def _letters(n: int) -> str:
    name = ""
    while n >= 0:
        name, n = chr(65 + n % 26) + name, n // 26 - 1
    return name


def _escaped(text: str) -> str:
    """Characters that XML can't hold (and what looks like one of them) as the
    format's _xHHHH_."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))


def unescaped(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _cell(at: str, style: int, value) -> str:
    if value is None:
        return f'<c r="{at}" s="{style}"/>'
    if isinstance(value, bool):
        return f'<c r="{at}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and value not in (float("inf"), float("-inf")):
        return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>'
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_escaped(str(value))}</t></is></c>'


def workbook(columns: list[str], rows: list[tuple], sheet: str = "Sheet", header: str = HEADER_COLOR, even: str = EVEN_COLOR) -> bytes:
    """One workbook.  A text longer than a cell goes on in columns named
    'name (2)', 'name (3)' and so on."""
    width = [max([1, *(-(-len(r[i]) // CELL) for r in rows if isinstance(r[i], str))]) for i in range(len(columns))]
    names = [c if k == 1 else f"{c} ({k})" for c, w in zip(columns, width) for k in range(1, w + 1)]

    def spread(row: tuple) -> list:
        out = []
        for value, w in zip(row, width):
            out += [value] if w == 1 else [value[k * CELL : (k + 1) * CELL] or (None if k else "") for k in range(w)] if isinstance(value, str) else [value] + [None] * (w - 1)
        return out

    letters = [_letters(i) for i in range(len(names))]
    widths = [len(n) + 2 for n in names]
    for row in rows[:SAMPLE]:
        widths = [min(WIDEST, max(w, len("" if v is None else str(v)) + 2)) for w, v in zip(widths, spread(row))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in _parts(sheet, header, even).items():
            z.writestr(zipfile.ZipInfo(part), HEAD + text)  # a fixed date: a task that runs again writes the same bytes
        with z.open(zipfile.ZipInfo(SHEET), "w") as f:
            cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            head = "".join(_cell(f"{a}1", 1, n) for a, n in zip(letters, names))
            f.write(f'{HEAD}<worksheet xmlns="{SPACE}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData><row r="1" ht="20" customHeight="1">{head}</row>'.encode())
            for n, row in enumerate(rows, 2):
                f.write(f'<row r="{n}">{"".join(_cell(f"{a}{n}", 2 + (n % 2 == 0), v) for a, v in zip(letters, spread(row)))}</row>'.encode())
            f.write(f'</sheetData><autoFilter ref="A1:{letters[-1]}{len(rows) + 1}"/></worksheet>'.encode())
    return out.getvalue()


def workbooks(df: DataFrame, name: str, sort_by: list[str] | None = None, rows: int = ROWS, size: int = BYTES, **look) -> DataFrame:
    """(path, n_rows, content): the frame as workbooks of at most ``rows`` rows
    and about ``size`` bytes of text, sorted over all of them if asked.  Null is
    a blank cell, numbers and truth values are themselves, other types text.
    An empty frame makes no workbook."""
    clash = [c for c in df.columns if re.fullmatch(r".* \(\d+\)", c, re.S)]
    if clash or len(set(df.columns)) < len(df.columns):
        raise ValueError(f"names that repeat or end in a number: {clash or df.columns}")
    columns = list(df.columns)
    df = df.select(*(F.col(f"`{f.name.replace('`', '``')}`") if isinstance(f.dataType, TYPES) else F.col(f"`{f.name.replace('`', '``')}`").cast("string").alias(f.name) for f in df.schema))
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df = df.toDF(*(f"c{i}" for i in range(len(columns))))  # any name goes into a header

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, weight, number = TaskContext.get().partitionId(), [], 0, 0

        def done() -> pa.RecordBatch:
            path = f"{name}-{task:05d}-{number:05d}.xlsx"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([workbook(columns, held, **look)], pa.binary())], ["path", "n_rows", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                weight += sum(len(v) if isinstance(v, str) else 8 for v in row)
                if len(held) >= rows or weight >= size:
                    yield done()
                    held, weight, number = [], 0, number + 1
        if held:
            yield done()

    return df.mapInArrow(build, "path string, n_rows long, content binary")


def sheet_records(data: bytes) -> Iterator[dict[str, str]]:
    """Rows of a workbook as {header: text}; blank cells have no entry."""
    names: dict[str, str] = {}
    with zipfile.ZipFile(io.BytesIO(data)).open(SHEET) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{MAIN}row":
                continue
            cells = {}
            for c in row.iter(f"{MAIN}c"):
                value = c.findtext(f"{MAIN}v")
                if c.get("t") == "inlineStr":
                    value = unescaped("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                if value is not None:
                    cells[c.get("r").rstrip("0123456789")] = value
            row.clear()
            if not names:
                names = cells
                continue
            out: dict[str, str] = {}
            for column, value in cells.items():
                name = re.sub(r" \(\d+\)$", "", names[column], flags=re.S)
                out[name] = out.get(name, "") + value
            yield out


def read_workbooks(books: DataFrame, schema: str) -> DataFrame:
    """Rows of workbooks that ``workbooks`` wrote (any frame with content, or
    Spark's binaryFile), cast to the columns and types of ``schema``."""
    typed = books.sparkSession.createDataFrame([], schema).schema
    names = typed.names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[dict] = []
                for record in sheet_records(content.as_py()):
                    held.append(record)
                    if len(held) == 1024:
                        yield table(held)
                        held = []
                if held:
                    yield table(held)

    def table(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], pa.string()) for n in names], [f"c{i}" for i in range(len(names))])

    text = books.select("content").mapInArrow(parse, ", ".join(f"c{i} string" for i in range(len(names))))
    as_type = lambda i, kind: F.col(f"c{i}") == "1" if isinstance(kind, BooleanType) else F.col(f"c{i}").cast(kind)
    return text.select(*(as_type(i, f.dataType).alias(f.name) for i, f in enumerate(typed)))


def free_path(spark: SparkSession, path: str) -> str:
    """The path, or with _v2, _v3 and so on the first that isn't taken."""
    jvm = spark._jvm  # noqa: SLF001
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    tried, number = path, 1
    while fs.exists(at(tried)):
        number += 1
        tried = f"{path}_v{number}"
    return tried


def write_workbooks(df: DataFrame, path: str, name: str = "sheet", **how) -> str:
    """The path that the workbooks were written to; a taken one is left alone."""
    taken = free_path(df.sparkSession, path)
    workbooks(df, name, **how).write.option("parquet.block.size", BYTES).parquet(taken)
    return taken
