"""Removal of byte strings that repeat across documents, by merging shard
Burrows-Wheeler transforms.

Rule: a byte goes if a ``SPAN``-byte string that covers it also starts in a
document with a smaller id; strings are judged on the input.

0. Of equal texts the smallest id's row goes through the steps below, the
   others lose every window.  A Bloom filter of the smallest ids' rows spares
   the others those steps; the few it lets through do no harm.
1. Every SPAN-byte window owns an anchor, the smallest 16-byte gram hash in
   it, so equal windows have equal anchors.  Anchors are counted over all
   documents; windows whose anchor occurs in one document only cannot repeat
   (a Bloom filter of fixed size lets some of them through, which is safe).
2. The other windows travel, as strings of consecutive windows with one
   anchor, to the bucket of the anchor: at most a few times the repeated
   text, packed, equal strings of a shard once.
3. In a bucket, an anchor with one distinct string is settled.  The strings
   of the others form one shard per origin.  Each shard's suffixes are
   sorted; the shards' transforms are then merged by iterative interleave
   refinement: each round splits the merged order by the preceding symbol and
   follows the LF mapping (two symbols a round), so after k rounds suffixes
   are ordered by their first 2 k symbols.  Where a round parts two
   neighbours their common prefix is known; what SPAN / 2 rounds leave
   together is a repeated interval.  The
   suffixes of different shards are never sorted again.
4. Each interval's smallest id decides; removals go back to their documents.

Defined results: null text is empty; texts under SPAN bytes lose nothing; a
null id counts as smaller than any id; rows that repeat an id do not remove
one another; equal texts under different ids leave the smallest id whole; an
empty table gives no rows.
"""

import functools
import hashlib
from array import array

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm import counting
from segq.llm.common import drop, free, hot_join, release, slim, text_of, tune, written
from segq.llm.filters import filter_of, lets_through, spot
from segq.llm.hashing import mix, sliding_min

SPAN, GRAM, CHUNK_BYTES, BUCKET_BYTES, NO_ID = 50, 16, 12 << 20, 2 << 20, -(1 << 63)


def anchors(data: bytes, span: int = SPAN) -> np.ndarray:
    """The anchor of each window of ``span`` bytes: a minimum, so mix() it to deal it."""
    if len(data) < span:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        grams = mix(words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xD6E8FEB86659FD93))
    return sliding_min(grams, span - GRAM + 1)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate([[0], edges]), np.concatenate([edges, [len(x)]])


def shard_order(text: np.ndarray, shard: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order inside each shard by prefix doubling from eight symbols;
    only suffixes that still tie are sorted again.  ``text`` has the symbols
    plus one, and 0 after each string; these terminators are distinct and sort
    by place."""
    n = len(text)
    left = np.empty(n, np.int64)  # symbols to the terminator
    left[:] = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    head = np.zeros(n, np.uint64)
    for i in range(7):
        head = head << np.uint64(9) | np.where(left > i, padded[i : n + i], 0).astype(np.uint64)
    order = np.argsort(head, kind="stable")
    order = order[np.argsort(shard[order].astype(np.uint16) if n and shard[-1] < 1 << 16 else shard[order], kind="stable")]
    key, owner = head[order], shard[order]
    short = left[order] < 7  # these hold their terminator and are told apart by place, as the sort is stable
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | short[1:]])
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = group
    h = 7
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(tied):
        rows = order[tied]
        key = rank[rows] * n + rank[np.minimum(rows + h, n - 1)]
        by = np.argsort(key, kind="stable")
        key, rows = key[by], rows[by]
        order[tied] = rows
        head = rank[rows]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return order


def merged_intervals(strings: list[bytes], shard: np.ndarray, depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(place in the concatenation, interval) of the suffixes whose first
    ``depth`` symbols, no string's end among them, occur more than once, in
    merged order; those that share an interval share the symbols.  A string
    of length m takes m + 1 places.  ``shard`` must not decrease."""
    lens = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(lens + 1)])
    n, ends = int(starts[-1]), starts[1:] - 1
    text = np.zeros(n, np.uint16)
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    order = shard_order(text, np.repeat(shard, lens + 1), ends)  # rows of the shards' transforms, one shard after another
    row_of = np.empty(n, np.int32)
    row_of[order] = np.arange(n, dtype=np.int32)
    one, two = order - 1, order - 2
    at = order - np.repeat(starts[:-1], lens + 1)[order]  # place inside the string
    # A round takes two symbols.  Rows at a string's start have no predecessor;
    # a row alone in its block stays alone, as do its predecessors, and leaves.
    symbol_of = np.where(at >= 2, ((text[two] - 1) << 8) | ((text[one] - 1) & 0xFF), 0).astype(np.uint16)
    lf, goes_on = row_of[two], at >= 2
    place, block = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for _ in range(depth // 2):
        going = goes_on[place]
        place, block = place[going], block[going]
        symbol = symbol_of[place]
        by_symbol = np.argsort(symbol, kind="stable")
        symbol, before = symbol[by_symbol], block[by_symbol]
        place = lf[place[by_symbol]]
        if not len(place):
            break
        edges = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1]), [True]]))
        sizes = np.diff(edges)
        many = sizes > 1
        place = place[np.repeat(many, sizes)]
        block = np.repeat(np.arange(int(many.sum()), dtype=np.int32), sizes[many])
    return order[place], block


def window_owners(strings: list[bytes], shard: np.ndarray, smallest: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For each string, concatenated: the smallest id over all strings that
    hold the window starting at each place (a string's own id included)."""
    lens = np.array([len(s) for s in strings])
    places, block = merged_intervals(strings, shard, span)
    out = np.repeat(smallest, lens + 1)
    if len(places):
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out[places] = np.repeat(np.minimum.reduceat(out[places], edges), np.diff(np.concatenate([edges, [len(block)]])))
    return out, np.concatenate([[0], np.cumsum(lens + 1)])


SHARD = "bucket long, chunk long, strings binary, lens binary, keys binary, smallest binary, row binary, doc binary, start binary, string binary"


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


@functools.cache
def _packer():
    return zstandard.ZstdCompressor(level=1)


@functools.cache
def _unpacker():
    return zstandard.ZstdDecompressor()


def _blob(a, kind: str) -> bytes:
    return _packer().compress(np.ascontiguousarray(a, kind).tobytes())


def _array(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_unpacker().decompress(bytes(blob)), kind)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    kept (the remaining bytes)."""
    spark = docs.sparkSession
    tune(spark)
    bits = counting.bucket_bits(spark)  # of counting
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID).cast("bigint"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), doc.alias("doc"), F.xxhash64(doc, text_of(text_col)).alias("row"), text_of(text_col).alias("text"))

    # Of equal texts, rows under a larger id than the smallest lose all windows.
    names = texts.select("doc", "row", F.md5("text").alias("same"), F.octet_length("text").alias("size"))
    first = names.groupBy("same").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("row", "doc").alias("node"), F.count("*").alias("m"))
    first = written(first, "texts")
    later = hot_join(names, first.filter("first <> last").select("same", "first", "m"), "same", "m").filter((F.col("doc") > F.col("first")) & (F.col("size") >= span)).select("row", "size").distinct()
    wanted = filter_of(first.select("node"))
    work = texts.select("row", "doc", "text", spot("row"))

    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(16, -(-total // (4 << 20)))
    deal = min(20, max(bits, (total // BUCKET_BYTES).bit_length()))  # bits of the shards' buckets: their size stays as the corpus grows

    def counted_blocks(batches):
        held, size = [], 0

        def flush():
            made = list(counting.blocks(np.concatenate(held), bits))
            return pd.DataFrame({"bucket": [b for b, _ in made], "blob": [x for _, x in made]})

        for pdf in batches:
            for text in pdf.loc[lets_through(wanted.value, pdf["spot"]), "text"]:
                low = anchors(_bytes(text), span)
                held.append(mix(np.unique(low[runs(low)[0]])))
                size += len(held[-1])
                if size >= counting.CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        slim()

    packed = written(work.select("text", "spot").mapInPandas(counted_blocks, "bucket long, blob binary"), "anchors")
    counted = spark.sparkContext.broadcast(counting.count(packed, bits, 1, 1 << 30))
    drop(packed)
    release(spark)

    def shards(batches):
        from pyspark import TaskContext

        held, size, chunk = {}, 0, 0

        def flush():
            for bucket, (strings, rows) in held.items():
                names = list(strings)
                rows = np.frombuffer(rows, np.int64).reshape(-1, 4)
                yield {
                    "bucket": bucket, "chunk": (TaskContext.get().partitionId() << 24) + chunk, "strings": _packer().compress(b"".join(names)),
                    "lens": _blob([len(s) for s in names], "<u4"), "keys": _blob([strings[s][1] for s in names], "<u8"), "smallest": _blob([strings[s][2] for s in names], "<i8"),
                    "row": _blob(rows[:, 0], "<i8"), "doc": _blob(rows[:, 1], "<i8"), "start": _blob(rows[:, 2], "<u4"), "string": _blob(rows[:, 3], "<u4"),
                }

        for pdf in batches:
            pdf = pdf[lets_through(wanted.value, pdf["spot"])]
            read, keys = [], [np.zeros(0, np.uint64)]
            for text in pdf["text"]:
                data = _bytes(text)
                low = anchors(data, span)
                begin, end = runs(low)
                read.append((data, begin, end))
                keys.append(low[begin])
            keys = mix(np.concatenate(keys))
            again, at = counted.value.repeated(keys), 0
            for row, doc, (data, begin, end) in zip(pdf["row"].tolist(), pdf["doc"].tolist(), read):
                own = slice(at, at := at + len(begin))
                here = again[own]
                for s, e, key in zip(begin[here].tolist(), end[here].tolist(), keys[own][here].tolist()):
                    mine = held.get(key >> (64 - deal))
                    if mine is None:
                        mine = held[key >> (64 - deal)] = ({}, array("q"))
                    strings, rows = mine
                    piece = data[s : e + span - 1]
                    known = strings.get(piece)
                    if known is None:
                        known = strings[piece] = [len(strings), key, doc]
                        size += len(piece)
                    elif doc < known[2]:
                        known[2] = doc
                    rows.extend((row, doc, s, known[0]))
                    size += 24
                if size >= CHUNK_BYTES:
                    yield pd.DataFrame(flush())
                    held, size = {}, 0
                    chunk += 1
        if held:
            yield pd.DataFrame(flush())
        held.clear()
        slim()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Removed windows of one bucket: (row, first window, windows)."""
        number: dict[bytes, int] = {}
        keys, smallest, origin, occurrences = [], [], [], []
        for part in pdf.sort_values("chunk").itertuples():
            raw, lens = _unpacker().decompress(bytes(part.strings)), _array(part.lens, "<u4").tolist()
            at, mine = 0, []
            for size, key, least in zip(lens, _array(part.keys, "<u8").tolist(), _array(part.smallest, "<i8").tolist()):
                piece = raw[at : at + size]
                at += size
                i = number.get(piece)
                if i is None:
                    i = number[piece] = len(keys)
                    keys.append(key)
                    smallest.append(least)
                    origin.append(part.chunk)
                elif least < smallest[i]:
                    smallest[i] = least
                mine.append(i)
            occurrences.append((_array(part.row, "<i8"), _array(part.doc, "<i8"), _array(part.start, "<u4").astype(np.int64), np.array(mine, np.int64)[_array(part.string, "<u4")]))
        row, doc, start, string = (np.concatenate(x) for x in zip(*occurrences))
        strings, keys, smallest = list(number), np.array(keys, np.uint64), np.array(smallest, np.int64)
        windows = np.array([len(s) - span + 1 for s in strings])
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(times[inverse] > 1)
        least, most = smallest.copy(), smallest.copy()
        owners, at = None, np.full(len(strings), -1, np.int64)
        if len(open_):
            _, shard = np.unique(np.array(origin)[open_], return_inverse=True)
            by_shard = np.argsort(shard, kind="stable")
            open_ = open_[by_shard]
            owners, begins = window_owners([strings[i] for i in open_], shard[by_shard], smallest[open_], span)
            at[open_] = begins[:-1]
            edges = np.stack([begins[:-1], begins[:-1] + windows[open_]], 1).ravel()
            least[open_] = np.minimum.reduceat(owners, edges)[::2]
            most[open_] = np.maximum.reduceat(owners, edges)[::2]
        whole = most[string] < doc
        out = [(row[whole], start[whole], windows[string[whole]])]
        part = np.flatnonzero(~whole & (least[string] < doc))
        if len(part):
            size = windows[string[part]]
            begin = np.concatenate([[0], np.cumsum(size)])
            which = np.repeat(np.arange(len(part)), size)
            inside = np.arange(int(begin[-1])) - begin[which]
            gone = owners[at[string[part]][which] + inside] < doc[part][which]
            head = np.flatnonzero(gone & ((inside == 0) | ~np.concatenate([[False], gone[:-1]])))
            tail = np.flatnonzero(gone & ((inside == size[which] - 1) | ~np.concatenate([gone[1:], [False]])))
            out.append((row[part][which[head]], start[part][which[head]] + inside[head], tail - head + 1))
        return by_target(*(np.concatenate(x) for x in zip(*out)))

    def by_target(row: np.ndarray, first: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        target = row % groups
        order = np.argsort(target, kind="stable")
        target, row, first, n = target[order], row[order], first[order], n[order]
        begin, end = runs(target)
        return pd.DataFrame({"target": target[begin], "row": [_blob(row[s:e], "<i8") for s, e in zip(begin, end)], "first": [_blob(first[s:e], "<i8") for s, e in zip(begin, end)], "n": [_blob(n[s:e], "<i8") for s, e in zip(begin, end)]})

    def whole(batches):
        for pdf in batches:
            if len(pdf):
                yield by_target(pdf["row"].to_numpy(np.int64), np.zeros(len(pdf), np.int64), pdf["size"].to_numpy(np.int64) - span + 1)

    removals = "target long, row binary, first binary, n binary"
    gone = work.mapInPandas(shards, SHARD).groupBy("bucket").applyInPandas(settle, removals)
    gone = written(gone.unionByName(later.mapInPandas(whole, removals)), "removals")
    free(counted, wanted)
    drop(first)
    release(spark)

    def cut(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, first, n = (np.concatenate([_array(b, "<i8") for b in right[c]]) if len(right) else np.zeros(0, np.int64) for c in ("row", "first", "n"))
        order = np.argsort(row, kind="stable")
        row, first, n = row[order], first[order], n[order]
        out = []
        for doc_id, name, text in zip(left["doc_id"], left["row"].to_numpy(np.int64), left["text"]):
            data = _bytes(text)
            lo, hi = np.searchsorted(row, [name, name + 1]) if name < (1 << 63) - 1 else (np.searchsorted(row, name), len(row))
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, first[lo:hi], 1)
            np.add.at(mark, first[lo:hi] + n[lo:hi] + span - 1, -1)
            keep = np.cumsum(mark)[: len(data)] == 0
            kept = np.frombuffer(data, np.uint8)[keep].tobytes()
            spans = int((~keep[1:] & keep[:-1]).sum() + (len(data) > 0 and not keep[0]))
            out.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    parts = texts.select("doc_id", "row", "text", F.pmod("row", F.lit(groups)).alias("target"))
    return parts.groupBy("target").cogroup(gone.groupBy("target")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
