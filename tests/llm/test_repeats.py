"""Repeated rows in mixing and toxicity, a whole mix by force, and the whole
pipeline."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from segq.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, source string"


def mix_by_force(spark, rows):
    """(doc_id, source, taken) of every row: sizes in a dictionary, the rows of
    a size in order of their hash."""
    hashed = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source", mixing.hash_of("doc_id", "text", mixing.SEED).alias("h")).collect()
    by_source = defaultdict(list)
    for r in hashed:
        by_source[r.source].append((len((r.text or "").split()), r.h, r.doc_id))
    names = sorted(by_source, key=lambda s: (s is None, s))
    totals = [sum(x[0] for x in by_source[s]) for s in names]
    goal = mixing.targets(totals, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    out = []
    for s, total, target in zip(names, totals, goal):
        whole = min(3, int(target // total)) if total else 0
        sizes = sorted({x[0] for x in by_source[s]})
        of = {k: sorted(x for x in by_source[s] if x[0] == k) for k in sizes}
        rest = int(round(target - whole * total)) if whole < 3 else 0
        add = mixing.fit(np.array(sizes), np.array([len(of[k]) for k in sizes]), rest)
        out += [(i, s, k * (whole + (place < n))) for k, n in zip(sizes, add.tolist()) for place, (_, _, i) in enumerate(of[k])]
    return Counter(out)


def sources(seed=6):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, words(rng.randrange(0, 30)), rng.choice(["a", "b", "c", None])) for i in range(400)]
    rows += [(1000, "one two three four", "rep")] * 1000 + [(None, "x y", "rep"), (None, None, "b")] * 30
    return rows + rows[:50]


def test_mix_by_force_with_repeated_rows(spark):
    rows = sources()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(table).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in got) == mix_by_force(spark, rows)
    per = defaultdict(int)
    for r in got:
        per[r.source] += r.taken
    for r in got:
        assert r.target - 5 <= per[r.source] <= r.target + 1
    copies = mixing.mixed(table)
    taken = Counter((r.doc_id, r.source) for r in copies.collect())
    want = Counter()
    for (i, s, n), times in mix_by_force(spark, rows).items():
        want[i, s] += n * times
    sizes = copies.groupBy("doc_id", "source").agg(F.sum(mixing.size_of("text")).alias("n")).collect()
    assert copies.columns == table.columns and {(r.doc_id, r.source): r.n for r in sizes if r.n} == {k: v for k, v in want.items() if v} and taken


def test_source_of_one_repeated_row_comes_near_its_target(spark):
    rows = [(1, "one two three four", "a")] * 1000 + [(i, "w " * 50, "b") for i in range(2, 60)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    mine = [r for r in got if r.source == "a"]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4 and len(mine) == 1000


def test_numbers_of_rows(spark):
    table = spark.range(500).select((F.col("id") % 3).alias("k"), F.lit("x").alias("at")).repartition(6)
    got = mixing.numbered(table, ["k"], "place").collect()
    for k in range(3):
        assert sorted(r.place for r in got if r.k == k) == list(range(1, sum(r.k == k for r in got) + 1))


def test_toxicity_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"word{i % 90} same shared words " + "bad" * (i % 2), "s") for i in range(900)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, y, *a: seen.append(len(y)))
    toxicity.train(docs, labels, max_rows=100)
    assert seen == [100]
    once = docs.limit(60)
    toxicity.train(once, labels)
    toxicity.train(once.union(once).union(once), labels)
    assert seen[1] == seen[2]


@pytest.mark.skipif(not os.path.exists(os.path.join(os.path.dirname(SF), "sf0.001")), reason="no tables")
def test_whole_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    # Each stage again by its plain meaning, on what the stage before kept.
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    taken = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert Counter(r.doc_id for r in out) == taken and 0 < len(taken) < docs.count()
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
