"""Prefix trie of conversations: double arrays per prefix shard.

1. A turn is a 16-byte key (SHA-256 of role and text) and the length of its
   text; texts are never shuffled.  A conversation is its keys in a row, its
   path, by turn.
2. Equal paths collapse to one row: smallest member, members, and the hash of
   their ids, which a task streams in blocks of at most ``BLOCK`` ids.
3. Paths are dealt to shards at bounds that are paths themselves (a sample of
   fixed size a shard), so a shard is a range of sorted paths.  A task numbers
   the turns of its shard densely, packs BASE and CHECK arrays over the numbers
   and walks them for all paths at once; CHECK names each node's parent, so
   sums of subtrees run up the arrays.
4. Only nodes on a shard's first path and on the next shard's first path can
   have members elsewhere.  These upper nodes come out as parts, are summed
   over all shards, and give their smallest member to the nodes below.  What a
   node must count once (itself, as a child, as a leaf, its text) is counted by
   the last shard that has it, which also has its last child.

Defined results: turns are ordered by turn (null first), turns of one number by
the key of role and text; null role and text are empty; repeated rows are turns
of their own.  Rows without a conversation id are in no conversation.  Texts of
any length are read once, for key and length.  An empty table has no node, not
even a root.  A conversation's keys (20 bytes a turn) and a shard (``SHARD``
bytes of distinct paths, or one longer path) must fit a task.  Other columns
are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm.common import partitions, slim, text_of, tune, written

KEY = 16
#: Ids of a block, bytes of distinct paths in a shard, sampled paths a shard.
BLOCK_BITS, SHARD, SAMPLE = 14, 8 << 20, 16
NODE = "shard long, shared boolean, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, members long, ends_sha256 string"


class DoubleArray:
    """A trie over dense codes 1..V in two arrays: the child of slot s by code
    c is slot BASE[s] + c, if CHECK there is s.  The root is slot 0."""

    def __init__(self, parents: np.ndarray, codes: np.ndarray):
        """From nodes in breadth-first order: each one's parent and code; node
        0 is the root."""
        order = np.lexsort((codes[1:], parents[1:])) + 1
        tops, first, count = np.unique(parents[order], return_index=True, return_counts=True)
        self.used = np.zeros(1 << 16, bool)
        self.used[0] = True
        self.slot = np.zeros(len(parents), np.int64)
        base = np.zeros(len(parents), np.int64)
        low = 1
        # Nodes with several children, those with most first, by first fit.
        for k in np.argsort(-count, kind="stable")[: int((count > 1).sum())]:
            mine = order[first[k] : first[k] + count[k]]
            offsets = codes[mine] - codes[mine[0]]
            low = self._next_free(low)
            at = self._fit(low, offsets)
            self._room(at + int(offsets[-1]))
            self.used[at + offsets] = True
            self.slot[mine] = at + offsets
            base[tops[k]] = at - codes[mine[0]]
        # Any free slot does for an only child, so these fill the gaps.
        single = first[count == 1]
        self._room(int(self.used.sum()) + len(single) + 1)
        free = np.flatnonzero(~self.used)[: len(single)]
        self.slot[order[single]] = free
        base[tops[count == 1]] = free - codes[order[single]]
        size = int(self.slot.max()) + 1
        self.base, self.check, self.code = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.base[self.slot] = base
        self.check[self.slot[1:]] = self.slot[parents[1:]]
        self.code[self.slot[1:]] = codes[1:]
        del self.used

    def _room(self, top: int) -> None:
        while top >= len(self.used):
            self.used = np.concatenate([self.used, np.zeros(len(self.used), bool)])

    def _next_free(self, low: int) -> int:
        while self.used[low]:
            step = np.flatnonzero(~self.used[low : low + 4096])
            low = low + int(step[0]) if len(step) else low + 4096
            self._room(low)
        return low

    def _fit(self, at: int, offsets: np.ndarray) -> int:
        """The first slot from ``at`` where all offsets are free."""
        while True:
            self._room(at + 512 + int(offsets[-1]))
            some = at + np.flatnonzero(~self.used[at : at + 512])
            for k in range(0, len(offsets), 64):
                some = some[~self.used[some[:, None] + offsets[k : k + 64]].any(1)]
                if not len(some):
                    break
            if len(some):
                return int(some[0])
            at += 512

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of slots by codes; -1 where there is none."""
        to = self.base[slots] + codes
        inside = (to > 0) & (to < len(self.check)) & (slots >= 0) & (codes > 0)
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == slots), to, -1)

    def find(self, codes: list[int]) -> int:
        """Slot of a prefix, -1 if no conversation begins with it."""
        at = np.zeros(1, np.int64)
        for c in codes:
            at = self.step(at, np.array([c], np.int64))
        return int(at[0])


class Shard:
    """The trie of a shard's sorted paths."""

    def __init__(self, paths: list[bytes]):
        raw = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
        self.lens = np.array([len(p) // KEY for p in paths], np.int64)
        starts = np.cumsum(self.lens) - self.lens
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        new = np.ones(len(raw), bool)
        new[1:] = (raw[order][1:] != raw[order][:-1]).any(1)
        rough = np.empty(len(raw), np.int64)
        rough[order] = np.cumsum(new) - 1
        self.keys = raw[order[new]]
        n_codes = max(1, len(self.keys))
        parents, codes, node = [np.zeros(1, np.int64)], [np.full(1, -1)], np.zeros(len(paths), np.int64)
        at, total = np.arange(len(paths)), 1
        depth = 0
        while True:
            at = at[self.lens[at] > depth]
            if not len(at):
                break
            ids, where = np.unique(node[at] * n_codes + rough[starts[at] + depth], return_inverse=True)
            parents.append(ids // n_codes)
            codes.append(ids % n_codes)
            node[at] = total + where
            total, depth = total + len(ids), depth + 1
        parents, codes = np.concatenate(parents), np.concatenate(codes)
        # Dense codes by first use, breadth first: siblings are then mostly neighbours.
        seen, first = np.unique(codes[1:], return_index=True)
        dense = np.zeros(n_codes, np.int64)
        dense[seen[np.argsort(first)]] = np.arange(1, len(seen) + 1)
        self.codes = dense[rough] if len(rough) else rough
        self.starts, self.dense = starts, dense
        self.trie = DoubleArray(parents, np.concatenate([[0], dense[codes[1:]]]))

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots on every path, one depth after the other: (path, slot, depth)."""
        at, slots = np.arange(len(self.lens)), np.zeros(len(self.lens), np.int64)
        who, where, deep, depth = [at], [slots], [np.zeros(len(at), np.int64)], 0
        while True:
            more = self.lens[at] > depth
            at, slots = at[more], slots[more]
            if not len(at):
                return np.concatenate(who), np.concatenate(where), np.concatenate(deep)
            slots = self.trie.step(slots, self.codes[self.starts[at] + depth])
            depth += 1
            who.append(at)
            where.append(slots)
            deep.append(np.full(len(at), depth))

    def on_path(self, path: bytes) -> list[int]:
        """Slots of the nodes on a path, as deep as they go."""
        keys = np.frombuffer(path, ">u8").reshape(-1, 2)
        slots = [0]
        for hi, lo in keys:
            # keys are sorted by both halves
            a, b = np.searchsorted(self.keys[:, 0], hi, "left"), np.searchsorted(self.keys[:, 0], hi, "right")
            k = a + int(np.searchsorted(self.keys[a:b, 1], lo))
            if k >= b or self.keys[k, 1] != lo:
                break
            to = self.trie.step(np.array(slots[-1:]), self.dense[k : k + 1])[0]
            if to < 0:
                break
            slots.append(int(to))
        return slots


def node_rows(shard: int, table: dict[str, list], bound: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """Nodes of a shard; ``bound`` is its own first path if paths come before
    it, ``after`` the next shard's first path."""
    order = sorted(range(len(table["path"])), key=table["path"].__getitem__)
    paths = [table["path"][k] for k in order]
    conv, n, ends = (np.array([table[c][k] for k in order], object if c == "ends_sha256" else np.int64) for c in ("conv_id", "n", "ends_sha256"))
    chars = np.array([x for k in order for x in table["chars"][k]], np.int64)
    part = Shard(paths)
    who, slot, deep = part.walk()
    size = len(part.trie.base)
    n_convs, least, depth, length = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1), np.zeros(size, np.int64)
    np.add.at(n_convs, slot, n[who])
    np.minimum.at(least, slot, conv[who])
    depth[slot] = deep
    below = deep > 0
    length[slot[below]] = chars[part.starts[who[below]] + deep[below] - 1]
    later = np.array(part.on_path(after) if after is not None else [], np.int64)
    shared = np.zeros(size, bool)
    shared[later] = True
    if bound is not None:
        shared[part.on_path(bound)] = True
    owned = depth >= 0
    owned[later] = False
    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    kids, born, leaves, saved = (np.zeros(size, np.int64) for _ in range(4))
    inner = nodes[nodes != 0]
    np.add.at(kids, part.trie.check[inner], owned[inner])
    np.add.at(born, part.trie.check[inner], 1)
    leaves[nodes] = owned[nodes] & (born[nodes] == 0)
    saved[nodes] = n_convs[nodes] * length[nodes] - owned[nodes] * length[nodes]
    levels = np.searchsorted(depth[nodes], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        level = nodes[levels[d] : levels[d + 1]]
        for sums in (leaves, saved):
            np.add.at(sums, part.trie.check[level], sums[level])
    ending = np.full(size, None, object)
    members = np.zeros(size, np.int64)
    last = np.zeros(len(paths), np.int64)
    last[who] = slot  # in order of depth, so the deepest stays
    ending[last], members[last] = ends, n
    # Digests of shared nodes and of their children's parents only.
    name: dict[int, bytes] = {}
    for path, slots in ((bound, part.on_path(bound) if bound is not None else []), (after, later.tolist())):
        for d, s in enumerate(slots):
            name[s] = hashlib.sha256(path[: KEY * d]).digest()[:KEY]
    top = np.where(nodes == 0, 0, part.trie.check[nodes])
    is_shared = shared[nodes]
    below_shared = shared[top] & (nodes != 0)
    parent_names = [name[t] if b else None for t, b in zip(top.tolist(), below_shared.tolist())]
    node_names = [name[s] if b else None for s, b in zip(nodes.tolist(), is_shared.tolist())]
    parent_conv = pa.array(least[top], mask=below_shared | (nodes == 0))
    columns = [
        pa.array(np.full(len(nodes), shard)), pa.array(is_shared), pa.array(node_names, pa.binary()), pa.array(parent_names, pa.binary()), pa.array(depth[nodes]), pa.array(least[nodes]), parent_conv,
        *(pa.array(x[nodes]) for x in (n_convs, kids, leaves, saved, members)), pa.array(ending[nodes].tolist(), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in NODE.split(", ")])


def paths_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, and its turns in order (key, chars)."""
    role = text_of(role_col)
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text_of(text_col)), 256), 1, 2 * KEY))
    turn = F.struct(F.col(turn_col).alias("turn"), key.alias("key"), F.length(text_of(text_col)).alias("chars"))
    found = rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with its first h = crc32(c) mod ``most`` turns taken
    from conversation c - c mod ``block`` (as many as that one has)."""
    c = F.col("conv_id")
    heads = convs.filter(c % block == 0).select(c.alias("head_id"), F.slice("turns", 1, most).alias("head"))
    both = convs.join(heads, c - c % block == F.col("head_id"), "left").withColumn("h", (F.crc32(c.cast("string").cast("binary")) % most).cast("int"))
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0)), own).alias("turns"))


def collapsed(convs: DataFrame) -> DataFrame:
    """One row per distinct path: path, chars, smallest member, members, and
    the hash of the members' ids."""
    rows = convs.select("conv_id", F.coalesce(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""), F.lit("")).alias("hex"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    rows = rows.select("conv_id", F.unhex("hex").alias("path"), "chars", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = rows.groupBy("path", "block").agg(F.first("chars").alias("chars"), ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "chars", "conv_id", "n", "ends_sha256"]
        schema = pa.schema([("path", pa.binary()), ("chars", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
        now, sha = None, None
        for batch in batches:
            out = []
            for path, chars, ids, n, conv in zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "ids", "n", "conv_id"))):
                if now is None or path != now[0]:
                    if now is not None:
                        out.append([*now, sha.hexdigest()])
                    now, sha = [path, chars, conv, n], hashlib.sha256(ids.encode())
                else:  # blocks come in ascending order
                    sha.update(b"," + ids.encode())
                    now[3] += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*now, sha.hexdigest()], schema.types)], names)

    ordered = blocks.repartition("path").sortWithinPartitions("path", "block")
    return written(ordered.mapInArrow(hashed, "path binary, chars array<int>, conv_id long, n long, ends_sha256 string"), "paths")


def bounds_of(paths: DataFrame, shard_bytes: int = SHARD) -> list[bytes]:
    """First paths of all shards but the first one: quantiles of a sample of
    ``SAMPLE`` paths a shard, those with the smallest hashes."""
    total, n = paths.agg(F.sum(F.length("path") + 40), F.count("*")).first()
    if not n:
        return []
    shards = max(partitions(paths.sparkSession), -(-total // shard_bytes))
    some = sorted(bytes(r.path) for r in paths.select("path", F.xxhash64("path").alias("x")).orderBy("x").limit(SAMPLE * shards).collect())
    return sorted({some[k * len(some) // shards] for k in range(1, shards)} - {min(some)})


def prefix_trie(convs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turns)."""
    spark = convs.sparkSession
    tune(spark)
    paths = collapsed(convs)
    bounds = bounds_of(paths, shard_bytes)
    shared = spark.sparkContext.broadcast(bounds)  # SAMPLE paths a shard at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect.bisect_right(shared.value, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], [*batch.schema.names, "shard"])

    def nodes(table: pa.Table) -> pa.Table:
        shard, bounds = table.column("shard")[0].as_py(), shared.value
        rows = {c: table.column(c).to_pylist() for c in ("path", "chars", "conv_id", "n", "ends_sha256")}
        out = node_rows(shard, rows, bounds[shard - 1] if shard else None, bounds[shard] if shard < len(bounds) else None)
        slim()
        return pa.Table.from_batches([out])

    dealt = paths.mapInArrow(deal, "path binary, chars array<int>, conv_id long, n long, ends_sha256 string, shard long")
    parts = written(dealt.groupBy("shard").applyInArrow(nodes, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "members")]
    upper = parts.filter("shared").groupBy("node").agg(F.first("parent", ignorenulls=True).alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    upper = written(upper, "upper")
    least = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper_conv_id"))
    whole = upper.join(least, "parent", "left").withColumn("parent_conv_id", F.col("upper_conv_id"))
    # Nodes below a shared one ask for its smallest member shard by shard, so a root's children stay dealt.
    asked = parts.filter("shared").select("shard", F.col("node").alias("parent")).join(least, "parent")
    lower = parts.filter("not shared and parent is not null").join(asked, ["shard", "parent"]).withColumn("parent_conv_id", F.col("upper_conv_id"))
    inside = parts.filter("not shared and parent is null")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "members"]
    return whole.select(columns).unionByName(lower.select(columns)).unionByName(inside.select(columns))


def trie_digest(nodes: DataFrame) -> DataFrame:
    """The columns of the query: the hash of no ids where no conversation ends."""
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
