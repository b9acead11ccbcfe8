"""Counting 64-bit keys over a corpus with compressed blocks.

Map side: the keys of a chunk of rows are sorted, cut to bits + 32 leading
bits, dealt to 2**bits buckets and packed as deltas (2 to 3 bytes a key).
Reduce side: one bucket's blocks are merged and counted.  Two things come out:
the heaviest keys, at most ``most`` of them in all, and a Bloom filter of the
keys counted at least twice.  Both have a fixed size that does not grow with
the corpus, so both may be broadcast.  A false positive of the filter only
costs work; nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm.common import partitions
from segq.llm.hashing import mix

FILTER_BITS, PROBES = 28, 3
CHUNK = 1 << 21


def bucket_bits(spark) -> int:
    """Buckets grow with the shuffle partitions the session asks for."""
    return min(18, max(6, (partitions(spark) - 1).bit_length()))


def pack(sorted_low: np.ndarray) -> bytes:
    """Ascending uint32 values as split byte planes of deltas, compressed."""
    deltas = np.diff(sorted_low.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(deltas.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32)


def blocks(keys: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of one chunk's keys; repeats count."""
    cut = np.sort(keys >> np.uint64(32 - bits))
    owner = (cut >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(owner, np.arange((1 << bits) + 1))
    low = (cut & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for b in range(1 << bits):
        if edges[b] < edges[b + 1]:
            yield b, pack(low[edges[b] : edges[b + 1]])


def owned_blocks(keys: np.ndarray, owners: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, block, the keys' owners) of one chunk; owners are its rows."""
    order = np.argsort(keys)
    cut, owners = keys[order] >> np.uint64(32 - bits), owners[order].astype("<u4")
    edges = np.searchsorted((cut >> np.uint64(32)).astype(np.int64), np.arange((1 << bits) + 1))
    low = (cut & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        yield b, pack(low[part]), planes(owners[part])


def planes(values: np.ndarray) -> bytes:
    """uint32 values as split byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def values(blob: bytes) -> np.ndarray:
    found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(found.T).view("<u4").ravel()


def owners_of_repeated(packed: DataFrame) -> DataFrame:
    """(chunk, owners): the rows of each chunk that own keys counted at least
    twice in the corpus, once for each such key.  ``packed`` has the columns
    bucket, chunk, blob and owners.  Answers go back to their chunk, so nothing
    is broadcast and no filter fills up as the corpus grows."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        lows = [unpack(b) for b in pdf["blob"]]
        low = np.concatenate(lows)
        order = np.argsort(low, kind="stable")
        same = low[order][1:] == low[order][:-1]
        again = np.zeros(len(low), bool)
        again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        begin = np.concatenate([[0], np.cumsum([len(x) for x in lows])])
        found = [values(o)[again[s:e]] for o, s, e in zip(pdf["owners"], begin, begin[1:])]
        return pd.DataFrame({"chunk": [c for c, f in zip(pdf["chunk"], found) if len(f)], "owners": [planes(f) for f in found if len(f)]}).astype({"chunk": np.int64})

    return packed.groupBy("bucket").applyInPandas(merge, "chunk long, owners binary")


def _spots(low: np.ndarray, slice_bits: int) -> np.ndarray:
    """Places of a key in its bucket's slice of the filter."""
    h = mix(low.astype(np.uint64) + np.uint64(1))
    return np.concatenate([(h >> np.uint64(20 * i)) & np.uint64((1 << slice_bits) - 1) for i in range(PROBES)]).astype(np.int64)


class Counted:
    """The broadcast outcome: heavy keys with their rank, and the filter."""

    def __init__(self, bits: int, heavy: np.ndarray, rank: np.ndarray, bitmap: np.ndarray, filter_bits: int):
        self.bits, self.heavy, self.rank, self.bitmap, self.filter_bits = bits, heavy, rank, bitmap, filter_bits

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank by ascending count of heavy keys, -1 for the others."""
        if not len(self.heavy):
            return np.full(len(keys), -1, np.int64)
        cut = keys >> np.uint64(32 - self.bits)
        at = np.minimum(np.searchsorted(self.heavy, cut), len(self.heavy) - 1)
        return np.where(self.heavy[at] == cut, self.rank[at], -1)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys counted once in the whole corpus."""
        cut = keys >> np.uint64(32 - self.bits)
        slice_bits = self.filter_bits - self.bits
        base = (cut >> np.uint64(32)).astype(np.int64) << slice_bits
        spots = _spots((cut & np.uint64(0xFFFFFFFF)).astype(np.uint32), slice_bits).reshape(PROBES, -1) + base
        return ((self.bitmap[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(0)


def count(packed: DataFrame, bits: int, most: int, least: int, filter_bits: int = FILTER_BITS) -> Counted:
    """Merge blocks (columns bucket, blob) into a ``Counted``."""
    slice_bits = filter_bits - bits

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.sort(np.concatenate([unpack(b) for b in pdf["blob"]]))
        edges = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]]))
        n, low = np.diff(edges), low[edges[:-1]]
        spots = _spots(low[n > 1], slice_bits)
        flags = np.zeros(1 << slice_bits, bool)
        flags[spots] = True
        bitmap = zstandard.ZstdCompressor(level=1).compress(np.packbits(flags, bitorder="little").tobytes())
        big = np.flatnonzero(n >= least)
        if len(big) > most:
            big = big[np.argsort(-n[big], kind="stable")[:most]]
        key = (int(pdf["bucket"].iloc[0]) << 32) + low[big].astype(np.int64)
        return pd.concat([pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "key": [-1], "n": [0], "bitmap": [bitmap]}), pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "key": key, "n": n[big], "bitmap": None})])

    from segq.llm.common import drop, written

    out = written(packed.groupBy("bucket").applyInPandas(merge, "bucket long, key long, n long, bitmap binary"), "counted")
    top = out.filter("key >= 0").select("key", "n").orderBy(F.desc("n"), "key").limit(most).toPandas().sort_values(["n", "key"], kind="stable")
    bitmap = np.zeros(1 << (filter_bits - 3), np.uint8)
    width = 1 << (slice_bits - 3)
    for row in out.filter("key < 0").select("bucket", "bitmap").toLocalIterator():
        bitmap[row.bucket * width : (row.bucket + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.bitmap)), np.uint8)
    drop(out)
    keys = top["key"].to_numpy(np.uint64)
    order = np.argsort(keys)
    return Counted(bits, keys[order], np.arange(len(keys))[order], bitmap, filter_bits)
