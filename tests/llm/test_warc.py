"""Archives: round trip by a reader of its own, assembly, revisits."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segq.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string, copy long, record_id string"


def pages():
    rng = random.Random(3)
    bodies = ["", None, "<p>one</p>", "WARC/1.1\r\n\r\nx", "é" * 500, "y\r\n\r\nz", "long " * 40000]
    rows = [(i, f"http://h{i % 3}.org/{i}", rng.choice(bodies)) for i in range(60)]
    rows += [(i, f"http://u.org/{i}", f"own {i}") for i in range(60, 90)]
    rows += [(200, "http://a.org/\r\nWARC-Type: bad", "same"), (200, "http://a.org/\r\nWARC-Type: bad", "same"), (200, "http://b.org", "same"), (None, None, "same"), (None, None, "alone"), (None, None, "alone")]
    return rows


def by_force(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        ids.sort(key=lambda i: (i is not None, i), reverse=True)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out += [(i, len(raw), digest, "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    return Counter(out)


def test_round_trip(spark):
    rows = pages()
    table = spark.createDataFrame([(*r, "d", "p", 7, "r") for r in rows], SCHEMA).repartition(4)
    got = warc.facts(warc.archived(table)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == by_force(rows)


def test_files_are_what_the_standard_says(spark, tmp_path):
    rows = pages()
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path))
    payloads, kinds = [], Counter()
    for name in [r.file for r in manifest.collect()]:
        data = gzip.decompress((tmp_path / name).read_bytes())
        while data:  # a reader of its own: whole stream, record by record
            head, rest = data.split(b"\r\n\r\n", 1)
            names = {k.lower(): v for k, v in re.findall(r"^([^:\r\n]+): (.*?)\r?$", head.decode(), re.M)}
            size = int(names["content-length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            block, data = rest[:size], rest[size + 4 :]
            kinds[names["warc-type"]] += 1
            if names["warc-type"] == "response":
                payloads.append(block.split(b"\r\n\r\n", 1)[1].decode())
    assert sorted(payloads) == sorted({r[2] or "" for r in rows})
    assert kinds["response"] + kinds["revisit"] == kinds["request"] == kinds["metadata"] == len(rows)
    nested = warc.assemble(warc.read_records(manifest, str(tmp_path))).filter("response.type = 'response'").select("response.payload").collect()
    assert sorted(bytes(r.payload).decode() for r in nested) == sorted(payloads)


def test_assembly_follows_identifiers_both_ways_and_over_chains(spark):
    rec = lambda i, kind, to=(): (i, kind, list(to), None, None, None, None, None, None)
    rows = [
        rec("a", "response", ["r1"]), rec("r1", "request"), rec("m1", "metadata", ["r1"]), rec("m2", "metadata", ["m1"]),
        rec("b", "revisit"), rec("r2", "request", ["b"]), rec("m3", "metadata", ["b", "r2"]), rec("lost", "metadata", ["nowhere"]), rec("i", "warcinfo"),
    ]
    got = {r.record_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(got) == {"a", "b"}
    ids = {k: ([x.record_id for x in r.request], [x.record_id for x in r.metadata]) for k, r in got.items()}
    assert ids == {"a": (["r1"], ["m1", "m2"]), "b": (["r2"], ["m3"])}


def test_no_pages(spark):
    assert warc.facts(warc.archived(spark.createDataFrame([], SCHEMA))).count() == 0


def test_broken_archive_is_refused():
    row = {"digest": b"x" * 20, "page_id": 1, "url": "u", "copy": 0, "payload": b"abc", "payload_bytes": 3, "first_id": None, "first_url": None}
    data = gzip.decompress(warc.capture(row)[1])
    assert warc.parse(data)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="ends"):
        list(warc.members(__import__("io").BytesIO(warc.capture(row)[1][:-20])))


def test_hot_payload_collapses_before_the_shuffle(spark):
    table = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("z" * 1000).alias("html"))
    kinds = Counter(r.record_type for r in warc.facts(warc.archived(table)).collect())
    assert kinds == {"response": 1, "revisit": 1999}
