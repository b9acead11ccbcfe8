"""The trie against a plain dictionary of prefixes, and the double arrays."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from segq.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, path string, shard long, node string, key string"


def by_force(rows, remake=True):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            convs.setdefault(c, []).append((t is not None, t or 0, key, role or "", text or ""))
    convs = {c: [(x[3], x[4]) for x in sorted(turns)] for c, turns in convs.items()}
    made = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if remake else 0
        made[c] = (convs.get(c - c % 100, [])[:h] if remake else []) + turns[h:]
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(ids) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), kids[p], leaves[p], saved[p], sha(ends.get(p, []))) for p, ids in members.items())


def dialogues(seed=2, n=230):
    rng = random.Random(seed)
    words = ["hi", "ok", "", None, "thanks", "é🙂", "why?", "no"]
    rows = []
    for c in [*range(0, n), 1000, 1001, 100000, 16384 * 3 + 1]:
        if c == 100:  # absent head of its block
            continue
        for t in range(rng.randrange(1, 8)):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(words) if rng.random() < 0.8 else f"own {rng.random()}"))
    rows += [(c, 0, "user", "the same") for c in range(2000, 2300)]  # equal conversations
    rows += [(5, t, "user", f"long {t % 7}") for t in range(10, 300)]
    rows += rows[:40] + [(None, 1, "user", "no conversation"), (7, None, None, None)]
    return rows


@pytest.mark.parametrize(("shard_bytes", "remake"), [(8 << 20, True), (400, True), (150, False)])
def test_nodes(spark, shard_bytes, remake):
    rows = dialogues()
    table = spark.createDataFrame([(*r, "x", 1, "x", "x") for r in rows], SCHEMA).repartition(3)
    convs = ct.paths_of(table)
    got = ct.trie_digest(ct.prefix_trie(ct.rebuilt(convs) if remake else convs, shard_bytes)).collect()
    assert Counter(map(tuple, got)) == by_force(rows, remake)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    from segq.llm import registry

    assert Counter(map(tuple, registry.op13_conversation_trie(spark, SF).collect())) == by_force(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ct.prefix_trie(ct.rebuilt(ct.paths_of(none))).count() == 0
    only = ct.prefix_trie(ct.rebuilt(ct.paths_of(spark.createDataFrame([(1, 0, "user", "x", "", 1, "", "")], SCHEMA)))).collect()
    h = zlib.crc32(b"1") % 6
    assert len(only) == (1 if h else 2) and all(r.n_convs == 1 for r in only)


def test_copies_of_one_conversation_collapse(spark):
    table = spark.range(40000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    got = ct.prefix_trie(ct.paths_of(table)).collect()
    want = hashlib.sha256(",".join(map(str, range(40000))).encode()).hexdigest()
    assert sorted((r.depth, r.n_convs, r.saved_tokens) for r in got) == [(0, 40000, 39999 * 5), (1, 40000, 39999 * 5)]
    assert next(r for r in got if r.depth == 1).ends_sha256 == want


def test_double_array_finds_what_was_put_in():
    rng = random.Random(4)
    seqs = sorted({bytes(16) * 0, *(b"".join(rng.randrange(40).to_bytes(16, "big") for _ in range(rng.randrange(1, 7))) for _ in range(800))})
    part = ct.Shard(seqs)
    prefixes = {s[: 16 * d] for s in seqs for d in range(len(s) // 16 + 1)}
    slots = {p: part.on_path(p)[-1] for p in prefixes}
    assert len(set(slots.values())) == len(prefixes) and int((part.trie.check >= 0).sum()) + 1 == len(prefixes)
    who, slot, deep = part.walk()
    assert all(slots[seqs[w][: 16 * d]] == s for w, s, d in zip(who.tolist(), slot.tolist(), deep.tolist()))
    codes = [int(part.dense[k]) for k in range(5)]
    assert part.trie.find([]) == 0 and part.trie.find([10**6]) == -1 and part.trie.find([codes[0], -5]) == -1
    assert len(part.trie.base) < 3 * len(prefixes) and np.unique(part.trie.slot).size == len(part.trie.slot)
