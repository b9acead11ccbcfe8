"""Mixing sources to target weights by subset-sum budget fitting.

Word counts are JVM expressions.  Documents are counted per (source, exact
size).  A source's target is whole copies of all its documents plus a rest
below its size; the rest is met by choosing how many documents of each size to
add: every size gives its share of the budget less ``WINDOW`` words, largest
sizes first with what a size could not give carried on, and a bounded-knapsack
dynamic programme over all sizes fills what is left of the budget.  It is the
same at every size of source.  One task holds one source's distinct sizes (not
its rows).

Which documents of a size are added is seeded: those with the smallest hashes
of (seed, id, text).  The hash up to which a size's documents are taken is
found by counting hashes in ``2**SLOT_BITS`` slots and ranking the one slot
that the count cuts, so no size's rows meet in one task.  A row's copies then
follow from its own source, size and hash and a table of one row per (source,
size), which is broadcast while it has at most ``BROADCAST_ROWS`` rows
(counted); so texts are not shuffled.  Beyond that it is joined.

Defined results: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken 0 words; an empty table gives no
rows.  Rows that repeat an id (or have none) are documents of their own; rows
that repeat id and text have one hash, and where the count ends among them, as
many of them as it asks for are taken once more: they are numbered part by
part, so a hot row's copies never meet in one task.  Fractions of a word cannot
be taken, so a source's words end at or just below its target.  A text of any
length is counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segq.llm.common import drop, fresh, text_of, tune, written

WEIGHTS, REPEATS, SEED, SLOT_BITS, WINDOW, BROADCAST_ROWS = (5, 2, 1), 3, 17, 12, 1 << 16, 200_000


def size_of(col: str = "text"):
    """Number of runs without white space."""
    return F.regexp_count(text_of(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum by weight; none above ``repeats`` times its size,
    the excess reshared by weight."""
    out, left, open_weight = [0.0] * len(sizes), float(sum(sizes)), float(sum(weights))
    by_room = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    for k, i in enumerate(by_room):  # sources fill up in this order
        if left / open_weight * weights[i] <= repeats * sizes[i]:
            for j in by_room[k:]:
                out[j] = left / open_weight * weights[j]
            break
        out[i] = float(repeats * sizes[i])
        left, open_weight = left - out[i], open_weight - weights[i]
    return out


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size make the largest sum within ``budget``; exact.

    The set of sums of the first lots is a bit set; counts are split into
    powers of two.  Every so many lots the set is kept, and the sets between
    are made again on the way back, so memory is the root of all sets."""
    lots, out = [], np.zeros(len(sizes), np.int64)
    for i, (s, c) in enumerate(zip(sizes.tolist(), counts.tolist())):
        c, part = min(c, budget // s if s else 0), 1
        while c > 0:
            lots.append((i, min(part, c), s * min(part, c)))
            c -= part
            part *= 2
    budget = min(budget, sum(total for _, _, total in lots))
    mask, step = (1 << (budget + 1)) - 1, max(1, math.isqrt(len(lots)))
    marks, now, used = [], 1, 0
    for _, _, total in lots:
        if used % step == 0:
            marks.append(now)
        now |= (now << total) & mask
        used += 1
        if now >> budget & 1:
            break
    at = now.bit_length() - 1
    for block in reversed(range(len(marks))):
        part, reach = lots[block * step : min(used, (block + 1) * step)], [marks[block]]
        for _, _, total in part[:-1]:
            reach.append(reach[-1] | (reach[-1] << total) & mask)
        for (i, n, total), before in zip(reversed(part), reversed(reach)):
            if not before >> at & 1:
                out[i] += n
                at -= total
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size to add so that words come to budget."""
    take, total = np.zeros(len(sizes), np.int64), int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    order = np.argsort(-sizes, kind="stable")
    share, carry = max(0, budget - window) / total, 0.0
    for i in order.tolist():
        want = share * float(counts[i]) * float(sizes[i]) + carry
        if sizes[i]:
            take[i] = min(int(counts[i]), int(want // sizes[i]))
        carry = want - float(take[i]) * float(sizes[i])
    take[order] += knapsack(sizes[order], (counts - take)[order], budget - int((take * sizes).sum()))
    return take


def key_of(source: Column) -> Column:
    """A source made safe for equi-joins (null: 'n')."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def hash_of(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col))


def plan(rows: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(key, size, source_size, target, whole, upto, cut, some) for rows (key,
    size, h): every document is taken ``whole`` times, and once more if its hash
    is at most ``upto`` (null: never) or if it is one of the first ``some`` rows
    with the hash ``cut``."""
    spark = rows.sparkSession
    ranked = [(r["key"], r["n"]) for r in rows.groupBy("key").agg(F.sum("size").alias("n")).toLocalIterator()]
    ranked.sort(key=lambda x: (x[0] == "n", x[0]))
    goal = targets([x[1] for x in ranked], [weights[i % len(weights)] for i in range(len(ranked))], repeats)
    goals = spark.createDataFrame([(k, n, g) for (k, n), g in zip(ranked, goal)], "key string, source_size bigint, target double")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        target, whole_size = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
        whole = min(repeats, int(target // whole_size)) if whole_size else 0
        rest = int(round(target - whole * whole_size)) if whole < repeats else 0
        return pdf.assign(whole=whole, add=fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), rest))

    counts = rows.groupBy("key", "size").agg(F.count("*").alias("n")).join(goals, "key")
    schema = "key string, size bigint, n bigint, source_size bigint, target double, whole bigint, add bigint"
    lots = written(counts.groupBy("key").applyInPandas(fitted, schema), "lots")

    slot = F.shiftright("h", 64 - SLOT_BITS).alias("slot")
    cut = lots.filter("add > 0 and add < n").select("key", "size", "add")
    before = Window.partitionBy("key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    hint = F.broadcast if few(lots) else lambda df: df  # at most one row of cut, slots and ends for each row of lots
    slots = rows.join(hint(cut.select("key", "size")), ["key", "size"], "left_semi").groupBy("key", "size", slot).agg(F.count("*").alias("m"))
    slots = slots.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).join(cut, ["key", "size"])
    slots = slots.filter("before < add and add <= before + m").select("key", "size", "slot", (F.col("add") - F.col("before")).alias("need"))
    inside = rows.select("key", "size", "h", slot).join(hint(slots), ["key", "size", "slot"]).groupBy("key", "size", "slot", "need", "h").agg(F.count("*").alias("m"))
    upto_here = F.sum("m").over(Window.partitionBy("key", "size", "slot").orderBy("h"))  # one row a hash
    below = F.when(F.col("slot") > -(1 << (SLOT_BITS - 1)), F.shiftleft(F.col("slot").cast("bigint"), 64 - SLOT_BITS) - 1)
    fits = F.col("upto_here") <= F.col("need")
    ends = inside.withColumn("upto_here", upto_here).groupBy("key", "size", "slot", "need").agg(F.max(F.when(fits, F.col("h"))).alias("last"), F.min(F.when(~fits, F.col("h"))).alias("next"), F.max(F.when(fits, F.col("upto_here"))).alias("got"))
    some = F.col("need") - F.coalesce("got", F.lit(0))
    ends = ends.select("key", "size", F.coalesce("last", below).alias("end"), F.when(some > 0, F.col("next")).alias("cut"), some.alias("some"))
    upto = F.when(F.col("add") >= F.col("n"), F.lit((1 << 63) - 1)).when(F.col("add") > 0, F.col("end"))
    out = written(lots.join(ends, ["key", "size"], "left").select("key", "size", "source_size", "target", "whole", upto.alias("upto"), "cut", "some"), "lots")
    drop(lots)
    return out


def few(lots: DataFrame) -> bool:
    """Whether one row per (source, size) may be broadcast."""
    return lots.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with the number of each in its group, from 1.  Rows are numbered
    within their part of a table and parts are put in a row, so no group is
    held in one task."""
    at, part, before = (fresh(x, rows) for x in ("at", "part", "before"))
    kept = written(rows.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "numbered")
    sizes = kept.groupBy(*by, part).agg(F.count("*").alias(before))
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = kept.withColumn(at, F.row_number().over(Window.partitionBy(*by, part).orderBy(at)))
    return own.join(sizes, [*by, part]).withColumn(name, F.col(at) + F.col(before)).drop(at, part, before)


def split_cut(joined: DataFrame, of: Callable[[str], Column], name: str) -> DataFrame:
    """``joined`` with the copies each row is taken, under ``name``; ``of``
    gives a column of the row's lot."""
    taken = lambda more: of("whole") + F.coalesce(more.cast("bigint"), F.lit(0))
    at_cut = F.coalesce(of("h") == of("cut"), F.lit(False))
    whole = joined.filter(~at_cut).withColumn(name, taken(of("h") <= of("upto")))
    keys = {fresh(f"cut_{k}", joined): of(k) for k in ("key", "size")}
    place = fresh("cut_place", joined)
    cut = numbered(joined.filter(at_cut).select("*", *(c.alias(k) for k, c in keys.items())), list(keys), place)
    return whole.unionByName(cut.withColumn(name, taken(F.col(place) <= of("some"))).drop(place, *keys))


def cuts(lots: DataFrame) -> bool:
    """Whether a count ends among rows of one hash anywhere."""
    return lots.filter("cut is not null").limit(1).count() > 0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken,
    copies."""
    tune(docs.sparkSession)
    columns = F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key_of(F.col(source_col)).alias("key"), size_of(text_col).alias("size"), hash_of(id_col, text_col, seed).alias("h")
    rows = written(docs.select(*columns), "sizes")
    lots = plan(rows, weights, repeats)
    joined = rows.join(F.broadcast(lots) if few(lots) else lots, ["key", "size"])
    out = split_cut(joined, F.col, "copies") if cuts(lots) else joined.withColumn("copies", F.col("whole") + F.coalesce((F.col("h") <= F.col("upto")).cast("bigint"), F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken."""
    tune(docs.sparkSession)
    mine = F.struct(key_of(F.col(source_col)).alias("key"), size_of(text_col).alias("size"), hash_of(id_col, text_col, seed).alias("h"))
    rows = written(docs.select(mine.alias("r")).select("r.*"), "sizes")
    lots = plan(rows, weights, repeats)
    drop(rows)
    a, b, c = (fresh(name, docs) for name in ("mix_row", "mix_lot", "mix_copy"))
    side = lots.select(F.struct(*lots.columns).alias(b))
    joined = docs.withColumn(a, mine).join(F.broadcast(side) if few(lots) else side, (F.col(f"{a}.key") == F.col(f"{b}.key")) & (F.col(f"{a}.size") == F.col(f"{b}.size")))
    of = lambda k: F.col(f"{a}.h" if k == "h" else f"{b}.{k}")
    if cuts(lots):
        out = split_cut(joined, of, c)
    else:
        out = joined.withColumn(c, of("whole") + F.coalesce((of("h") <= of("upto")).cast("bigint"), F.lit(0)))
    return out.withColumn(c, F.explode(F.array_repeat(F.lit(1), F.col(c).cast("int")))).drop(a, b, c)
