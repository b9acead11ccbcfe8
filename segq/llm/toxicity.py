"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and the distinct first
four and five letters of its words (insults inflect), hashed to 2**20 places.
score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>): the factors learn pairs,
such as an insult with a group mention, that additive weights miss.

Learning takes labelled rows only, at most ``MAX_ROWS`` of them in order of a
hash of the id, after the join of labels and documents (a documented bound:
24,000 rows, small enough to broadcast their ids and labels).  Their terms are hashed and counted on the executors.
Places that occur in fewer than ``MIN_DF`` of these rows are left out, and of
the others the ``PLACES`` most informative (chi-square) stay; only those reach
the driver, which fits the model.
Scoring is one pandas UDF over whole texts with the model broadcast (under
1 MB); documents are never shuffled but for the join with the labels.

Defined results: null and empty texts have no terms and get the bias; a row
without an id or a label is scored but not learnt from; repeated labels of an
id all count; no labels at all gives the score 0 everywhere.  The score never
looks at labels, lang, source or ids.  Repeated rows of one id and text are one
row to learn from; an id with several texts is several, by id, label and the
text's hash.  A text of any length is its distinct terms.
"""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm.common import crc_mod, drop, text_of, tune, written

BITS, MAX_ROWS, MIN_DF, PLACES, FACTORS, THRESHOLD, SEED = 20, 24_000, 4, 4096, 4, 0.7, 7
WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (4, 5)


def terms(text: str | None) -> list[bytes]:
    words = set(WORD.findall((text or "").lower()))
    out = {f"w:{w}" for w in words}
    for n in LENGTHS:
        out |= {f"{n}:{w[:n]}" for w in words if len(w) > n}
    return out


def places(text: str | None) -> np.ndarray:
    """Sorted distinct hashed places of a text's terms."""
    mask = (1 << BITS) - 1
    found = {zlib.crc32(t.encode("utf-8", "surrogatepass")) & mask for t in terms(text)}
    return np.fromiter(sorted(found), np.int64, len(found))


class Model:
    """Known places (sorted), bias, weights and factors."""

    def __init__(self, known: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.known, self.bias, self.weights, self.factors = known, bias, weights, factors
        self.slot = {int(k): i for i, k in enumerate(known)}

    def score(self, text: str | None) -> float:
        slot = self.slot
        at = [slot[p] for p in places(text).tolist() if p in slot]
        v = self.factors[at]
        raw = self.bias + self.weights[at].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(raw, -40, 40))))


def counts(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have each place, and how many of them have label 1."""
    none, size = [np.zeros(0, np.int64)], 1 << BITS
    return np.bincount(np.concatenate(rows or none), minlength=size), np.bincount(np.concatenate([r for r, t in zip(rows, y) if t] or none), minlength=size)


def informative(df: np.ndarray, both: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Places with enough rows, by the chi-square of place and label."""
    keep = np.flatnonzero(df >= MIN_DF)
    df, both = df[keep].astype(float), both[keep].astype(float)
    chi = (both - df * pos / n) ** 2 / np.maximum(1e-9, df * (n - df) * pos * (n - pos))
    return np.sort(keep[np.argsort(-chi, kind="stable")[:PLACES]])


def fit(rows: list[np.ndarray], y: np.ndarray, known: np.ndarray | None = None, epochs: int = 12, batch: int = 256, rate: float = 0.03, decay: float = 2e-4, seed: int = SEED) -> Model:
    """Mini-batch Adam on the logistic loss of the factorization machine."""
    rng = np.random.default_rng(seed)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.int64), 40.0 if len(y) and y.all() else -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    known = informative(*counts(rows, y), len(y), int(y.sum())) if known is None else known
    at = [np.searchsorted(known, r[np.isin(r, known, assume_unique=True)]) for r in rows]
    lens, flat = np.array([len(a) for a in at]), np.concatenate(at)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    d = len(known)
    theta = np.concatenate([np.zeros((d, 1)), rng.normal(0, 0.01, (d, FACTORS))], 1)
    bias, m, s, step = np.log(y.mean() / (1 - y.mean())), np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            n = lens[pick]
            owner = np.repeat(np.arange(len(pick)), n)
            ids = flat[np.repeat(starts[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            part = theta[ids]
            sums = np.zeros((len(pick), FACTORS))
            np.add.at(sums, owner, part[:, 1:])
            squares = np.bincount(owner, (part[:, 1:] ** 2).sum(1), len(pick))
            raw = bias + np.bincount(owner, part[:, 0], len(pick)) + 0.5 * ((sums**2).sum(1) - squares)
            err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]
            grad = np.zeros_like(theta)
            np.add.at(grad, ids, np.concatenate([np.ones((len(ids), 1)), sums[owner] - part[:, 1:]], 1) * err[owner, None])
            grad = grad / len(pick) + decay * theta
            step += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            bias -= rate * err.mean()
    return Model(known, float(bias), theta[:, 0], theta[:, 1:])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    spark = docs.sparkSession
    tune(spark)
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 3) != 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    order = F.xxhash64(F.lit(SEED), "_id"), "_id", "_y"
    marks = marks.distinct().orderBy(*order).limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    # The bound holds for rows learnt from, so it is drawn after the join: an id may have many texts.
    picks = written(texts.join(F.broadcast(marks), "_id").select("_id", "_y", "_h").distinct().orderBy(*order, "_h").limit(max_rows), "toxicity-picks")

    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([places(t).astype("<i4").tobytes() for t in texts])

    rows = texts.join(F.broadcast(picks), ["_id", "_h"]).select("_id", "_y", "_h", F.pandas_udf(hashed, "binary")("_text").alias("p"))
    sample = written(rows.groupBy("_id", "_y", "_h").agg(F.first("p").alias("p")), "toxicity-sample")  # repeated rows are one
    drop(picks)

    def counted(batches):
        total, n, pos = None, 0, 0
        for pdf in batches:
            y = pdf["_y"].to_numpy()
            n, pos = n + len(y), pos + int(y.sum())
            part = np.stack(counts([np.frombuffer(p, "<i4") for p in pdf["p"]], y))
            total = part if total is None else total + part
        if n:
            yield pd.DataFrame({"n": [n], "pos": [pos], "total": [zlib.compress(total.astype("<i4").tobytes(), 1)]})

    total, n, pos = np.zeros((2, 1 << BITS), np.int64), 0, 0
    for row in sample.coalesce(4).mapInPandas(counted, "n long, pos long, total binary").toLocalIterator():
        n, pos = n + row.n, pos + row.pos
        total += np.frombuffer(zlib.decompress(bytes(row.total)), "<i4").reshape(2, -1)
    if not 0 < pos < n:
        return fit([], np.array([1] * (pos > 0)))
    known = informative(*total, n, pos)
    shared = spark.sparkContext.broadcast(known)

    def slots(rows: pd.Series) -> pd.Series:
        found = (np.frombuffer(p, "<i4") for p in rows)
        return pd.Series([p[np.isin(p, shared.value, assume_unique=True)].astype("<i4").tobytes() for p in found])

    found = sample.select("_id", "_y", F.pandas_udf(slots, "binary")("p").alias("p")).toPandas().sort_values(["_id", "_y", "p"], kind="stable")
    drop(sample)
    return fit([np.frombuffer(p, "<i4").astype(np.int64) for p in found["p"]], found["_y"].to_numpy(np.int64), known)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts])

    return docs.withColumn(name, F.pandas_udf(score, "double")(text_of(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
