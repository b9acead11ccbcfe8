import io
import json
import zipfile

from segq.sources import files

DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>'


def make(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", DOC)


def test_docx_import_and_export(spark, tmp_path):
    make(tmp_path / "a.docx")
    segments = files.import_segments(files.read_docx(spark, str(tmp_path))).orderBy("segment_order").collect()
    assert [(r.block_type, r.source_text) for r in segments] == [("paragraph", "One two"), ("paragraph", "Three"), ("table_cell", "Cell")]
    out = files.docx_bytes((tmp_path / "a.docx").read_bytes(), ["1", "2", "3"])
    assert [t for _, _, t in files.docx_blocks(out)] == ["1", "2", "3"]
    assert zipfile.ZipFile(io.BytesIO(out)).testzip() is None


def test_tsv_keeps_rows_with_two_values(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("﻿a\tb\tc\nx\ty\t\nz\t\t\n")
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "g.tsv"), ["a", "b", "c"]).collect()] == [("x", "y", "")]


def test_state_migrates_quality(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"projects": [{"id": 1, "segments": [{"id": 2, "source": "s"}]}], "glossary": [], "tm": [{"src": "a", "tgt": "b", "verified": True}]}))
    state = files.read_state(spark, str(tmp_path / "s.json"))
    assert state["segments"].first().source == "s" and state["tm"].first().quality == "verified"
