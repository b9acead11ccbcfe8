"""Equal texts in suffix dedup: one row of each goes through the merge."""

import hashlib
import random

from segq.llm import counting, suffix_dedup

SCHEMA = "doc_id long, text string"


def by_force(rows, span=50):
    key = lambda i: suffix_dedup.NO_ID if i is None else i
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            seen[b[k : k + span]] = min(key(i), seen.get(b[k : k + span], key(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] < key(i):
                mark[k : k + span] = b"\1" * span
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((str(i), len(b), sum(mark), sum(part != b"" for part in bytes(mark).split(b"\0")), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts():
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    one, two = words(200), words(150)
    rows = [(100 + i, one) for i in range(120)] + [(i, words(60)) for i in range(20)]
    rows += [(40, two[:300] + one[100:400]), (300, two), (20, two), (None, two), (None, two), (20, two), (21, "short"), (22, "short"), (23, None), (24, None)]
    return rows + [(25, one + " end"), (26, "x" * 50), (27, "x" * 50), (28, "x" * 49), (29, "x" * 49), (30, "x" * 400)]


def test_copies_of_whole_texts_by_force(spark):
    rows = texts()
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == by_force(rows)


def test_copies_are_not_counted_again(spark, monkeypatch):
    """The anchors counted are about those of the distinct texts."""
    counted, write = [], suffix_dedup.written

    def written(df, name):
        out = write(df, name)
        if name == "anchors":
            counted.append(sum(len(counting.unpack(bytes(r.blob))) for r in out.collect()))
        return out

    monkeypatch.setattr(suffix_dedup, "written", written)
    text = " ".join(f"w{i}" for i in range(400))
    for copies in (1, 100):
        suffix_dedup.suffix_dedup(spark.createDataFrame([(i, text) for i in range(copies)], SCHEMA)).collect()
    assert 0 < counted[1] <= 2 * counted[0]
