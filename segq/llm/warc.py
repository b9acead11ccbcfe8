"""WARC archives: one transaction of three records a capture, and assembly.

Writing: a capture is a request, a response (or a revisit of an equal payload)
and a metadata record; the other two name the response in WARC-Concurrent-To.
Records are gzip members of their own.  Payloads are grouped by SHA-1 with
map-side partial aggregates, so copies collapse before the shuffle and each
distinct payload travels once; revisits carry no payload.  Record ids are
derived from the capture, so a retried task writes the same records.  Each task
writes files under names no other attempt uses, and a manifest that Spark
commits names those of the attempts that succeeded.

Reading: a task streams the records of its files, one member at a time.
Records are joined through their concurrent-to identifiers, in either direction
and over chains, by shuffles on the identifier, and one nested row per capture
comes out: request, response, metadata.

Defined results: a null payload is empty; an empty payload is a payload like
any other, and empty payloads equal one another.  Of equal payloads the one
with the largest id is the response; a null id is the smallest; rows that
repeat id and payload are captures of their own, one the response and the
others revisits of it.  A null url has no target header; characters that a
header cannot hold are percent-encoded in it.  Records that name no known
response stay out of the assembly.  A payload must fit a task.  An empty table
gives no archive and no rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm.common import drop, hot_join, new_path, slim, text_of, tune, written
from segq.llm.token_files import file_system, uri_of

#: Fixed values of the WARC 1.1 standard.
VERSION, REVISIT = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records have no time of their own in a table of pages; a parameter.
DATE = "2000-01-01T00:00:00Z"
#: Level of the members; payload bytes after which a task opens the next file.
LEVEL, FILE_BYTES = 1, 1 << 30
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
MANIFEST = "file string, n_records long"
RECORD = "record_id string, type string, concurrent array<string>, uri string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    """A urn of a capture's record that depends on nothing but the capture."""
    return uuid.uuid5(NAMES, "\x00".join(map(str, parts))).urn


def record(kind: str, rid: str, headers: list[tuple[str, str | None]], block: bytes, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    if kind == "response":
        lines.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    lines += [f"Content-Length: {len(block)}", "", ""]
    data = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    # A small record takes a small window, which is quick to set up.
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31) if len(data) > 4096 else zlib.compressobj(LEVEL, zlib.DEFLATED, 16 + 12, 4)
    return pack.compress(data) + pack.flush()


def header_text(value: str | None) -> str | None:
    """A value that stays on its line: controls are percent-encoded."""
    return value and "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def capture(row: dict, date: str = DATE) -> list[bytes]:
    """The three records of a capture."""
    key = (row["digest"], row["page_id"], row["url"], row["copy"])
    names = {kind: record_id(kind, *key) for kind in ("request", "response", "metadata")}
    uri, digest = header_text(row["url"]), base64.b32encode(row["digest"]).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    target, linked = ("WARC-Target-URI", uri), ("WARC-Concurrent-To", f"<{names['response']}>")
    shared = [target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if row["copy"] == 0 and row["payload"] is not None:
        kind, block = "response", http + row["payload"]
    else:
        kind, block = "revisit", http
        shared += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{record_id('response', row['digest'], row['first_id'], row['first_url'], 0)}>"), ("WARC-Refers-To-Target-URI", header_text(row["first_url"]))]
    fields = [("page-id", row["page_id"]), ("refers-to-page-id", row["first_id"] if kind == "revisit" else None)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
    ask = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
    return [
        record("request", names["request"], [target, linked, ("Content-Type", "application/http; msgtype=request")], ask, date),
        record(kind, names["response"], shared, block, date),
        record("metadata", names["metadata"], [target, linked, ("Content-Type", "application/warc-fields")], about, date),
    ]


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row per capture to write; the payload only where it is the response."""
    data = F.encode(text_of(payload_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), data.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("payload_bytes", F.length("payload").cast("long"))
    # Two aggregates, both with map-side parts: the payloads, and the captures of each without them.
    first = F.max(F.struct("page_id", "url"))
    payloads = rows.groupBy("digest", "payload_bytes").agg(first.alias("first"), F.first("payload").alias("payload"))
    responses = payloads.select(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), "digest", "payload_bytes", "payload", F.lit(0).alias("copy"), *(F.lit(None).cast(t).alias(c) for c, t in (("first_id", "long"), ("first_url", "string"))))
    seen = written(rows.groupBy("digest", "payload_bytes", "page_id", "url").agg(F.count("*").alias("n")), "captures")
    firsts = seen.groupBy("digest").agg(first.alias("first"), F.count("*").alias("groups"), F.sum("n").alias("rows")).filter("rows > 1")
    again = hot_join(seen, written(firsts, "firsts"), "digest", "groups").filter("first is not null")
    mine = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    copies = F.explode(F.sequence(F.when(mine, 1).otherwise(0).cast("long"), F.col("n") - 1))
    revisits = again.filter(~mine | (F.col("n") > 1)).select("page_id", "url", "digest", "payload_bytes", F.lit(None).cast("binary").alias("payload"), copies.alias("copy"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return responses.unionByName(revisits)


def write_archives(pages: DataFrame, folder: str, date: str = DATE, **columns) -> DataFrame:
    """Write the captures of ``pages`` as archives; returns the manifest."""
    spark = pages.sparkSession
    tune(spark)
    uri = uri_of(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(uri)
        out, name, size, n = None, "", 0, 0
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 1
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(record("warcinfo", record_id("warcinfo", name), [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date))
                for member in capture(row, date):
                    out.write(member)
                size, n = size + row["payload_bytes"], n + 3
                if size > FILE_BYTES:
                    close()
        close()
        slim()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["file", "n_records"])

    return written(captures(pages, **columns).mapInArrow(write, MANIFEST), "warc-manifest")


def members(src, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    held, at = b"", 0
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at == len(held):
                held, at = src.read(size), 0
            if not held:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            piece = held[at : at + 4096]  # what is unused of it is copied
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts)


def fields_of(block: bytes) -> dict[str, str]:
    """Named fields, one a line; a line that begins with white space goes on."""
    out, last = {}, None
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parse(data: bytes, with_payload: bool = True) -> dict:
    """A record: headers, and of a response or revisit the payload's facts."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a record")
    names = fields_of(lines)
    block = rest[: int(names["content-length"])]
    if names.get("warc-block-digest") not in (None, f"sha1:{base32_sha1(block)}"):
        raise ValueError(f"{names.get('warc-record-id')}: wrong digest")
    bare = lambda x: x and x.strip("<>")
    # The header may stand more than once, which the dictionary does not keep.
    linked = [bare(line.split(b":", 1)[1].strip().decode()) for line in lines.split(b"\r\n") if line.lower().startswith(b"warc-concurrent-to:")]
    kind, fields, payload, digest, size = names["warc-type"], None, None, None, None
    if kind == "metadata":
        fields = fields_of(block)
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, size = base32_sha1(payload), len(payload)
        else:
            digest = (names.get("warc-payload-digest") or "").removeprefix("sha1:")
            size, payload = int(fields_of(http).get("content-length", 0)), None
    return {
        "record_id": bare(names["warc-record-id"]), "type": kind, "concurrent": linked, "uri": names.get("warc-target-uri"), "refers_to": bare(names.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": size, "fields": list(fields.items()) if fields is not None else None, "payload": payload if with_payload else None,
    }


def read_records(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives."""
    uri = uri_of(folder)
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as src:
                    for data in members(src):
                        held.append(parse(data, with_payload))
                        size += len(data) if with_payload else 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)
        slim()

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response, metadata.

    Identifiers are followed by joins: records that name a response (or are
    named by one) take its id, then those that name them, until none is new."""
    anchors = F.col("type").isin("response", "revisit")
    ids = records.filter(F.col("type").isin("request", "metadata", "response", "revisit"))
    heads = ids.filter(anchors).select("record_id", F.col("record_id").alias("capture"))
    edges = ids.select("record_id", F.explode("concurrent").alias("other"))
    edges = written(edges.union(edges.select("other", "record_id")).distinct(), "edges")
    named = edges.join(heads.select(F.col("record_id").alias("other"), "capture"), "other").join(heads.select("record_id"), "record_id", "left_anti")
    found, new = [], written(named.groupBy("record_id").agg(F.min("capture").alias("capture")), "linked")
    known = new
    while new.count():
        found.append(new)
        # Whoever names, or is named by, a record just linked and is not linked itself.
        near = edges.join(new.select(F.col("record_id").alias("other"), "capture"), "other")
        near = near.join(known.select("record_id"), "record_id", "left_anti").join(heads.select("record_id"), "record_id", "left_anti")
        new = written(near.groupBy("record_id").agg(F.min("capture").alias("capture")), "linked")
        known = known.union(new)
    drop(new)
    linked = heads
    for df in found:
        linked = linked.union(df)
    one = F.struct(*records.columns)
    parts = ids.withColumn("record", one).select("record_id", "type", "record").join(linked, "record_id").groupBy("capture")
    of = lambda *kinds: F.when(F.col("type").isin(*kinds), F.col("record"))
    many = lambda kind: F.array_sort(F.collect_list(of(kind)), lambda a, b: F.when(a.record_id < b.record_id, -1).when(a.record_id > b.record_id, 1).otherwise(0))
    out = parts.agg(F.first(of("response", "revisit"), ignorenulls=True).alias("response"), many("request").alias("request"), many("metadata").alias("metadata"))
    return out.select(F.col("capture").alias("record_id"), "request", "response", "metadata")


def archived(pages: DataFrame, folder: str | None = None, with_payload: bool = False, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back and assemble the captures."""
    folder = folder or new_path(pages.sparkSession, "warc")
    records = read_records(write_archives(pages, folder, **options), folder, with_payload)
    return assemble(records if with_payload else written(records, "records"))


def facts(captured: DataFrame) -> DataFrame:
    """Per capture: the page, and what its archive says of the payload."""
    about = F.col("metadata")[0]["fields"]
    return captured.select(
        about["page-id"].cast("long").alias("page_id"), F.col("response.payload_bytes"), F.col("response.payload_digest"), F.col("response.type").alias("record_type"),
        about["refers-to-page-id"].cast("long").alias("refers_to"), F.col("response.uri").alias("uri"), "record_id",
    )
