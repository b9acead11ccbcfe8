"""Benchmark decontamination by winnowed fingerprints.

A text keeps, of each ``SLIDE`` consecutive k-gram hashes, the smallest
(k = ``GRAM`` words).  GRAM + SLIDE - 1 = 13, so any 13 words that a document
shares with an item share a kept hash.  Document fingerprints are joined with
item fingerprints, and each hit is extended to the 13-word windows around it,
which are looked up by hash and compared word for word.  An item of fewer
words is one window; for those, each distinct length n is winnowed alone with
k = n and a slide of one, as no shorter guarantee exists.

The benchmark's bytes are counted first.  Up to ``BROADCAST_BYTES`` its
fingerprints and windows (about seven bytes for each byte of text) are
broadcast: the join is a lookup in the map over the documents, which are not
shuffled.  A larger benchmark is dealt to parts of at most that size; the
fingerprints of both sides meet in a shuffled join that names the parts each
distinct text shares a fingerprint with, and only those texts travel to those
parts, in groups of bounded size.  Both ways give the same rows.

Defined results: null or empty text has no words and is clean; items without
words match nothing; a null item_id counts as an item named ''; repeated items
count by distinct item_id; an empty benchmark leaves all clean; repeated rows
of documents all keep their own result.  A text longer than any limit is
processed whole.  Other columns pass untouched; a column of the result's name
is replaced.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segq.llm.common import fresh, slim, tune, written
from segq.llm.hashing import ALNUM, byte_values, gram_hashes, sliding_min, span_hashes, words_of

WINDOW, GRAM, SLIDE, BROADCAST_BYTES, GROUP_BYTES, SHARE = 13, 6, 8, 4 << 20, 8 << 20, 20


def winnow(hashes: np.ndarray, slide: int) -> np.ndarray:
    """Positions whose hash is the smallest of some window of ``slide``; all
    windows of a shorter text count as one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = sliding_min(hashes, min(slide, len(hashes)))
    keep = np.zeros(len(hashes), bool)
    for i in range(min(slide, len(hashes))):  # a hash is kept if it equals the minimum of any window that covers it
        keep[i : i + len(low)] |= hashes[i : i + len(low)] == low
    return np.flatnonzero(keep)


def shape(n_words: int) -> tuple[int, int, int]:
    """(window, gram, slide) of an item of so many words."""
    return (WINDOW, GRAM, SLIDE) if n_words >= WINDOW else (n_words, n_words, 1)


class Windows:
    """Windows of one size: sorted distinct hashes, for each a word position
    where it stands, and the items that hold it (``item[first[i]:first[i+1]]``);
    and the fingerprints."""

    def __init__(self, hashes: np.ndarray, position: np.ndarray, item: np.ndarray, prints: np.ndarray):
        order = np.lexsort((item, hashes))
        hashes, position, item = hashes[order], position[order], item[order]
        keep = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])]) if len(hashes) else np.zeros(0, bool)
        hashes, position, self.item = hashes[keep], position[keep], item[keep].astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        self.hashes, self.position, self.first = hashes[begin], position[begin].astype(np.int32), np.append(begin, len(hashes)).astype(np.int32)
        self.prints = prints


def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in a sorted array, -1 for those that are not in it."""
    if not len(sorted_):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


class Index:
    """Items as one run of lower-cased bytes with word bounds, and their
    windows by size: some seven bytes for each byte of text."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.names = sorted({"" if i is None else str(i) for i, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        raw, starts, ends, parts, at, n = [], [], [], {}, 0, 0
        for item, text in items:
            data, begin, end = words_of(text, ALNUM)
            if not len(begin):
                continue
            size, gram, slide = shape(len(begin))
            words = span_hashes(byte_values(data), begin, end)
            hashes, grams = gram_hashes(words, size), gram_hashes(words, gram)
            mine = parts.setdefault(size, ([], [], [], []))
            mine[0].append(hashes)
            mine[1].append(n + np.arange(len(hashes)))
            mine[2].append(np.full(len(hashes), number["" if item is None else str(item)]))
            mine[3].append(grams[winnow(grams, slide)])
            raw.append(data.tobytes())
            starts.append((begin + at).astype(np.int32))
            ends.append((end + at).astype(np.int32))
            at, n = at + len(data), n + len(begin)
        self.raw = b"".join(raw)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (starts, ends))
        self.windows = {size: Windows(*(np.concatenate(x) for x in mine[:3]), np.unique(np.concatenate(mine[3]))) for size, mine in sorted(parts.items())}

    def match(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items found."""
        data, starts, ends = words_of(text, ALNUM)
        n, items = len(starts), set()
        hit = np.zeros(n + 1, np.int64)
        if not n or not self.windows:
            return n, hit[:n] > 0, items
        hashes, raw = span_hashes(byte_values(data), starts, ends), None
        for size, windows in self.windows.items():
            if n < size:
                continue
            _, gram, slide = shape(size)
            grams = gram_hashes(hashes, gram)
            at = winnow(grams, slide)
            at = at[member(windows.prints, grams[at]) >= 0]
            begins = np.unique((at[:, None] - np.arange(size - gram + 1)).ravel())
            begins = begins[(begins >= 0) & (begins <= n - size)]
            found = member(windows.hashes, span_hashes(hashes, begins, begins + size)) if len(begins) else begins
            begins, found = begins[found >= 0], found[found >= 0]
            if not len(begins):
                continue
            raw = raw or data.tobytes()
            for i, w in zip(begins.tolist(), found.tolist()):
                q = int(windows.position[w])
                mine = [raw[s:e] for s, e in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())]
                if mine == [self.raw[s:e] for s, e in zip(self.starts[q : q + size].tolist(), self.ends[q : q + size].tolist())]:
                    items.update(self.names[k] for k in windows.item[windows.first[w] : windows.first[w + 1]].tolist())
                    hit[i] += 1
                    hit[i + size] -= 1
        return n, np.cumsum(hit)[:n] > 0, items


def prints_of(text: str | None, sizes: list[int]) -> np.ndarray:
    """Distinct fingerprints of a document for windows of the sizes."""
    data, starts, ends = words_of(text, ALNUM)
    hashes, out = span_hashes(byte_values(data), starts, ends), [np.zeros(0, np.uint64)]
    for size in sizes:
        if len(starts) >= size:
            _, gram, slide = shape(size)
            grams = gram_hashes(hashes, gram)
            out.append(grams[winnow(grams, slide)])
    return np.unique(np.concatenate(out))


HITS = "n_words bigint, hit binary, items array<string>"


def matched(index: Index, texts) -> pd.DataFrame:
    rows = [index.match(t) for t in texts]
    return pd.DataFrame({"n_words": [r[0] for r in rows], "hit": [np.packbits(r[1]).tobytes() for r in rows], "items": [sorted(r[2]) for r in rows]})


def hits_by_broadcast(text: Column, items: DataFrame) -> Column:
    """Struct of word count, packed hit flags and items."""
    index = items.sparkSession.sparkContext.broadcast(Index([(r.item, r.t) for r in items.collect()]))  # its bytes are counted

    def match(texts: pd.Series) -> pd.DataFrame:
        return matched(index.value, texts)

    return F.pandas_udf(match, HITS)(text)


def hits_by_join(texts: DataFrame, items: DataFrame, total: int, most: int) -> DataFrame:
    """(k, struct ``hits``) of distinct texts (k, t) that share a fingerprint
    with an item; by a shuffled join of fingerprints."""
    n_parts = -(-2 * total // most) + 1
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "t"), F.lit(n_parts)).cast("int"))

    def item_prints(batches):
        for pdf in batches:
            rows = []
            for part, text in zip(pdf["part"], pdf["t"]):
                n = len(words_of(text, ALNUM)[1])
                if n:
                    size = shape(n)[0]
                    rows += [(part, size, h) for h in prints_of(text, [size]).view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["part", "size", "h"])
        slim()

    prints = written(items.select("part", "t").mapInPandas(item_prints, "part int, size int, h long").distinct(), "item-prints")
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # at most 13

    def text_prints(batches):
        for pdf in batches:
            rows = [(k, h) for k, t in zip(pdf["k"], pdf["t"]) for h in prints_of(t, sizes).view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["k", "h"])
        slim()

    pairs = texts.mapInPandas(text_prints, "k string, h long").join(prints.select("part", "h").distinct(), "h").select("k", "part").distinct()
    pairs = written(texts.select("k", F.octet_length("t").alias("n")).join(pairs, "k"), "shared-prints")
    deal = pairs.groupBy("part").agg(F.ceil(F.sum("n") / GROUP_BYTES).cast("int").alias("deals"))
    left = texts.join(pairs.select("k", "part").join(F.broadcast(deal), "part").withColumn("deal", F.pmod(F.xxhash64("k"), F.col("deals")).cast("int")), "k")
    right = items.join(deal, "part").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([left[["k"]].reset_index(drop=True), matched(Index(list(zip(right["item"], right["t"]))), left["t"])], axis=1)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = np.bitwise_or.reduce(np.stack([np.frombuffer(h, np.uint8) for h in pdf["hit"]]))
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "n_words": pdf["n_words"].iloc[:1], "hit": [hit.tobytes()], "items": [sorted(set().union(*pdf["items"]))]})

    schema = f"k string, {HITS}"
    found = left.select("part", "deal", "k", "t").groupBy("part", "deal").cogroup(right.select("part", "deal", "item", "t").groupBy("part", "deal")).applyInPandas(match, schema)
    return found.groupBy("k").applyInPandas(merged, schema).select("k", F.struct("n_words", "hit", "items").alias("hits"))


VERDICT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def verdict(found: pd.DataFrame) -> pd.DataFrame:
    n_hit = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in found["hit"]]
    return pd.DataFrame({
        "n_words": found["n_words"], "n_hit": n_hit, "n_items": [len(x) for x in found["items"]],
        "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found["items"]],
        "contaminated": [h > 0 and SHARE * h >= n for h, n in zip(n_hit, found["n_words"])],
    })


def decontamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = BROADCAST_BYTES, name: str = "hits") -> DataFrame:
    """``docs`` with one more column, a struct ``name``: n_words, n_hit,
    n_items, items_sha256, contaminated."""
    tune(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    final = F.pandas_udf(verdict, VERDICT)
    if total <= most:
        return docs.withColumn(name, final(hits_by_broadcast(text, items)))
    k, hits = (fresh(c, docs) for c in ("text_key", "text_hits"))
    keyed = docs.withColumn(k, F.sha2(text, 256))
    texts = keyed.groupBy(F.col(k).alias("k")).agg(F.first(text).alias("t"))
    found = hits_by_join(texts, items, total, most).select(F.col("k").alias(k), F.col("hits").alias(hits))
    none = F.struct(F.size(F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"), F.lit(1))).cast("bigint").alias("n_words"), F.lit(b"").alias("hit"), F.array().cast("array<string>").alias("items"))
    joined = keyed.join(found, k, "left").withColumn(name, final(F.coalesce(F.col(hits), none)))
    return joined.select(*[c for c in docs.columns if c != name], name)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN windows ON dw.k = windows.k AND dw.s = windows.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
