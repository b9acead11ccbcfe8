"""Token-ID files: independent zstandard frames, checksums, a seek table.

Layout of a file (the public zstandard seekable format):

* data frames, each an independent zstandard frame of little-endian unsigned
  ids of one or more whole documents (about ``FRAME_IDS`` ids a frame; a
  longer document has a frame of its own);
* one skippable frame that holds the compressed document index: for each
  document its id, frame, first id inside the frame and number of ids;
* one skippable frame with the seek table: compressed size, decompressed size
  and the low 32 bits of xxh64 of each frame, then the frame count, the
  descriptor (0x80: checksums) and the seekable magic number.

A reader takes the tail, the index and then only the frames of the documents
it wants, and verifies each frame's checksum.

Writing is one range shuffle by id; each task sorts its range, encodes with
the tokenizers library and writes its own file under a name no other attempt
uses.  The manifest, a table that Spark commits, names the files of the
attempts that succeeded, so retries and speculative tasks leave only orphans.

Special strings of the vocabulary that stand in a text become their ids, as
the library does by default; ``special_as_text`` makes them ordinary text.

Defined results: null text is empty and has the end id alone; a null id sorts
first and is stored as null; repeated ids stay apart, ordered by
a hash of the text, then the text; an empty table gives no file and no rows.
Other columns are not read.
"""

from __future__ import annotations

import functools
import io
import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segq.llm.common import new_path, slim, text_of, tune, written

FRAME_IDS, LEVEL, END_ID = 1 << 17, 1, 0
#: Fixed values of the zstandard seekable format.
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX, CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])


def _xxh(data: bytes) -> int:
    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


class TokenFileWriter:
    """Appends documents to a binary file object; ``close`` writes the tail."""

    def __init__(self, out, width: int = 4, frame_ids: int = FRAME_IDS):
        self.out, self.dtype, self.frame_ids = out, np.dtype(f"<u{width}"), frame_ids
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.index, self.held, self.n_held = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self.n_held, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.held).astype(self.dtype).tobytes()
            data = self.pack.compress(raw)
            self.out.write(data)
            self.frames.append((len(data), len(raw), _xxh(raw)))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        raw = struct.pack("<B", self.dtype.itemsize) + np.array(self.index, INDEX).tobytes()
        body = struct.pack("<I", len(raw)) + self.pack.compress(raw)
        self.out.write(struct.pack("<II", SKIP_INDEX, len(body)) + body)
        self.frames.append((8 + len(body), 0, _xxh(b"")))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class TokenFileReader:
    """Random access by document; only the frames asked for are read."""

    def __init__(self, src):
        self.src = src
        size = src.seek(0, io.SEEK_END)
        src.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a token file")
        src.seek(size - 9 - 12 * count)
        table = np.frombuffer(src.read(12 * count), "<u4").reshape(-1, 3)
        self.ends = np.cumsum(table[:, 0].astype(np.int64))
        self.sizes, self.sums = table[:, 1], table[:, 2]
        self.unpack = zstandard.ZstdDecompressor()
        src.seek(int(self.ends[-1]) - int(table[-1, 0]) + 8)
        body = src.read(int(table[-1, 0]) - 8)
        raw = self.unpack.decompress(body[4:], max_output_size=struct.unpack("<I", body[:4])[0])
        self.dtype, self.index = np.dtype(f"<u{raw[0]}"), np.frombuffer(raw[1:], INDEX)
        self._frame: tuple[int, np.ndarray] | None = None

    def frame(self, i: int) -> np.ndarray:
        if self._frame is None or self._frame[0] != i:
            begin = int(self.ends[i - 1]) if i else 0
            self.src.seek(begin)
            raw = self.unpack.decompress(self.src.read(int(self.ends[i]) - begin), max_output_size=int(self.sizes[i]))
            if _xxh(raw) != self.sums[i]:
                raise ValueError(f"frame {i}: wrong checksum")
            self._frame = (i, np.frombuffer(raw, self.dtype))
        return self._frame[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        row = self.index[i]
        return self.frame(int(row["frame"]))[int(row["first"]) : int(row["first"]) + int(row["n"])]

    def documents(self, ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the documents asked for."""
        for i in np.flatnonzero(np.isin(self.index["doc_id"], list(ids)) & (self.index["no_id"] == 0)):
            yield int(self.index["doc_id"][i]), self.document(i)


def file_system(uri: str):
    """pyarrow's file system for a folder that all nodes share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri_of(uri))


def uri_of(folder: str) -> str:
    """The folder's URI; a path without a scheme is one that all nodes mount."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


#: A space that white space follows: no cut there.
SPACE_RUN = re.compile(r" \s")
#: ASCII punctuation that a word may end with.  The apostrophe is not in it,
#: as some endings that begin with one are cut in another way.
TAIL = string.punctuation.replace("'", "")


def parts_of(piece: str) -> list[str]:
    """Keys of the parts of a piece between which the byte-level pre-tokenizer
    always cuts: before and after a line feed with no white space beside it
    (the part then begins with the line feed), and between a letter or digit
    and the punctuation that ends a line (key: a space, then the punctuation).
    Many words with punctuation are then few words and few endings."""
    lines = piece.split("\n")
    if len(lines) > 1 and not all(s and not s[0].isspace() and not s[-1].isspace() for s in lines):
        return [piece]
    out, lead = [], ""
    for s in lines:
        core = s.rstrip(TAIL)
        if len(core) < len(s) and core and core[-1].isalnum() and core[-1] < "\u0250":
            out += [lead + core, " " + s[len(core) :]]
        else:
            out.append(lead + s)
        lead = "\n"
    return out


def load_tokenizer(path: str, special_as_text: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = special_as_text
    return tok


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece of a
    task once.  A text is cut before every space that a character other than
    white space follows: the byte-level pre-tokenizer always cuts there too,
    and merges never cross its cuts, so the ids of the pieces in a row are the
    ids of the text.  New pieces are cut once more (``parts_of``).  Pieces are
    kept as packed ids and emptied at ``most`` bytes, about a million.  A text
    that holds a special string, and every text of a vocabulary with another
    pre-tokenizer or a normalizer, is encoded whole."""

    def __init__(self, path: str, special_as_text: bool = False, most: int = 192 << 20):
        self.tok, self.most, self.known, self.held = load_tokenizer(path, special_as_text), most, {}, 0
        self.special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        kind = json.loads(self.tok.to_str())
        cut = kind["pre_tokenizer"] or {}
        #: Whether the cuts hold: byte-level, its usual pattern, no normalizer.
        self.cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not kind["normalizer"]
        tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.spaced = np.array([t.startswith("Ġ") for t in tokens])  # ids whose bytes begin with a space
        self.lined = np.array([t.startswith("Ċ") for t in tokens])  # and with a line feed

    def pieces(self, text: str) -> list[str]:
        """The pieces; all but the first lack the space they begin with."""
        parts = text.split(" ")
        if parts[-1] and not SPACE_RUN.search(text):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(code.ids, self.kind) for code in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode unknown pieces by way of their unknown parts."""
        known, whole, made = self.known, [], []
        for p in new:
            if p.isalpha() or len(keys := parts_of(p)) == 1:
                whole.append(p)
            else:
                made.append((p, keys))
        parts = {k for _, keys in made for k in keys}.difference(known, whole)
        self._learn_led(" ", whole + [k for k in parts if k[0] not in " \n"])
        self._learn_led("\n", [k[1:] for k in parts if k[0] == "\n"])
        tails = [k for k in parts if k[0] == " "]
        known.update((k, x.tobytes()) for k, x in zip(tails, self._ids([k[1:] for k in tails])))
        known.update([(p, b"".join([known[k] for k in keys])) for p, keys in made])

    def _learn_led(self, lead: str, new: list[str]) -> None:
        """Encode many pieces at once, each behind ``lead``.  A piece without
        it has one id that begins with it, its first; those ids part the
        pieces.  Other pieces are encoded one by one."""
        opens, key = (self.spaced, "") if lead == " " else (self.lined, lead)
        plain = [p for p in new if lead not in p]
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            ids = self._ids([lead + lead.join(part)])[0]
            edges = np.flatnonzero(opens[ids])
            if len(edges) != len(part):  # not a vocabulary of this kind
                self._learn_each(lead, key, part)
                continue
            edges, data = (edges * self.width).tolist(), ids.tobytes()
            edges.append(len(data))
            self.known.update(zip([key + p for p in part] if key else part, map(data.__getitem__, map(slice, edges, edges[1:]))))
        if len(plain) < len(new):
            self._learn_each(lead, key, [p for p in new if lead in p])

    def _learn_each(self, lead: str, key: str, new: list[str]) -> None:
        self.known.update((key + p, x.tobytes()) for p, x in zip(new, self._ids([lead + p for p in new])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return self._ids(texts)
        whole = [any(x in t for x in self.special) for t in texts]
        if any(whole):
            special = iter(self._ids([t for t, w in zip(texts, whole) if w]))
            plain = iter(self.encode([t for t, w in zip(texts, whole) if not w]))
            return [next(special if w else plain) for w in whole]
        if not texts:
            return []
        if self.held > self.most:
            self.known, self.held = {}, 0
        parts = [self.pieces(t) for t in texts]
        firsts = self._ids([part.pop(0) for part in parts])
        new = set().union(*parts).difference(self.known)
        self._learn(list(new))
        self.held += 200 * len(new) + 2 * sum(map(len, new))  # bytes, as measured for a piece and its parts
        packed = self.known.__getitem__
        return [np.frombuffer(first.tobytes() + b"".join(map(packed, part)), self.kind) for first, part in zip(firsts, parts)]


@functools.lru_cache(maxsize=1)
def kept_encoder(path: str, special_as_text: bool) -> Encoder:
    """The encoder that a worker keeps from task to task."""
    return Encoder(path, special_as_text)


MANIFEST = "file string, shard long, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, special_as_text: bool = False, keep: bool = True) -> DataFrame:
    """Write token files in ascending id order; returns the manifest table.
    With ``keep`` a worker's encoder, at most 192 MB of pieces, serves the tasks
    that follow too; without it, its memory is free after each task."""
    tune(docs.sparkSession)
    uri = uri_of(folder)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, writer, out, n_docs, n_ids, name = TaskContext.get().partitionId(), None, None, 0, 0, ""
        encoder = None
        for pdf in batches:
            if pdf.empty:
                continue
            if writer is None:
                encoder = (kept_encoder if keep else Encoder)(tokenizer, special_as_text)
                store, path = file_system(uri)
                store.create_dir(path, recursive=True)
                name = f"shard-{shard:08d}-{uuid.uuid4().hex}.tok"
                out = store.open_output_stream(f"{path}/{name}")
                writer = TokenFileWriter(out, encoder.width)
            for part in range(0, len(pdf), 64):
                rows = pdf.iloc[part : part + 64]
                for doc_id, code in zip(rows["doc_id"], encoder.encode(rows["text"].tolist())):
                    ids = np.append(code, encoder.kind.type(end_id))
                    writer.add(None if pd.isna(doc_id) else int(doc_id), ids)
                    n_docs += 1
                    n_ids += len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"file": [name], "shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids]})
            writer = encoder = None
            slim()

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # The range's bounds are sampled to the driver: a hash in them, not texts.
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return written(ordered.mapInPandas(encode, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    uri = uri_of(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(uri)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}") as src:
                    reader = TokenFileReader(src)
                    n = reader.index["n"].astype(np.int64)
                    sums = np.fromiter((zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(len(n))), np.int64, len(n))
                    ids = pa.array(reader.index["doc_id"].astype(np.int64), mask=reader.index["no_id"] > 0)
                    starts = row["start"] + np.concatenate([[0], np.cumsum(n)[:-1]])
                    out = pa.RecordBatch.from_arrays([ids, pa.array(starts.astype(np.int64)), pa.array(n), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    for k in range(0, out.num_rows, 1 << 16):
                        yield out.slice(k, 1 << 16)

    n_files = max(1, manifest.count())
    return files.repartition(n_files, "shard").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files and return what the files hold."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, **options), folder)
