"""Alignment of two tokenizers on the same texts, each distinct text once.

1. One shuffle by the full text leaves each distinct text once, with the number
   of documents that have it.
2. A task encodes its texts with both vocabularies and aligns them on byte
   offsets: where tokens of both end, a group ends; tokens whose byte ranges
   overlap are linked.  Every text is cut at single spaces between other
   characters.  No entry of either vocabulary crosses such a cut, so groups
   and links don't either, and a piece is encoded and aligned once a task.
3. A pair's count sums its links in each distinct text, weighed by the number
   of documents.  Counts of at most ``most`` pairs are broadcast as packed
   arrays; more are joined to the texts' pairs by salted shuffles.
4. The measures are joined to the documents by the text's digest; digests of
   many documents (at most 1,024 of them) take a broadcast.

Defined results: a null or empty text, and one whose bytes either vocabulary
does not give back, has no tokens: zeros and an empty string.  Strings of
special tokens are plain text.  Rows that repeat id and text give a row each
and count twice; a null id is kept.  Texts are encoded piece by piece, so a
very long one costs no more than many short ones, but its result (the groups
as text while they are hashed, and its distinct pairs) must fit a task.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm.common import hot_join, slim, tune, written
from segq.llm.token_files import Encoder

#: Pairs whose counts are broadcast (16 bytes each), bytes of pieces a task
#: keeps, slots a frequent pair is dealt to in the shuffled join.
MOST, KEPT, SALTS = 1 << 22, 96 << 20, 64
#: A pair of ids as one long.
SHIFT = 32
#: Spaces that are no cut: beside white space, or at an end of the text.
ODD, CUT = re.compile(r"\s | \s|^ | $"), re.compile(r"(?<=\S) (?=\S)")
MEASURES = "digest binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_tokens(path: str) -> list[bytes]:
    """Bytes of the entries of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    out = []
    for i in range(tok.get_vocab_size()):
        entry = tok.id_to_token(i) or ""
        out.append(bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode())
    return out


def piece_tokens(model) -> list[bytes]:
    """Bytes of the entries of a sentencepiece vocabulary."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]


class Aligned:
    """Pieces of texts, encoded and aligned, as columns over piece numbers."""

    def __init__(self, path_a: str, path_b: str, most: int = KEPT):
        import sentencepiece

        self.a = Encoder(path_a, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_tokens(path_a), piece_tokens(self.b)
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Whether the cuts hold for both vocabularies.
        self.cuts = self.a.cuts and not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number, self.groups, self.held = {}, [], 0
        self.parts: list[np.ndarray] = []  # of columns: ok, n_a, n_b, n_groups, n_links
        self.links: list[np.ndarray] = []
        self._table = None
        self.a.known = {}

    def pieces(self, text: str) -> list[str]:
        """Pieces of space+text, each without the space it begins with."""
        if not self.cuts:
            return [text]
        return CUT.split(text) if ODD.search(text) else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Encode and align unknown pieces, all in one pass over their bytes."""
        if self.a.cuts:
            self.a._learn([p for p in new if p not in self.a.known])  # noqa: SLF001
            packed = [self.a.known[p] for p in new]
            ids_a = np.frombuffer(b"".join(packed), self.a.kind).astype(np.int64)
            n_a = np.array(list(map(len, packed)), np.int64) // self.a.width
        else:
            found = self.a.encode([" " + p for p in new])
            ids_a, n_a = np.concatenate(found).astype(np.int64), np.array(list(map(len, found)), np.int64)
        found = self.b.encode(new, num_threads=1)
        ids_b, n_b = np.array([i for x in found for i in x], np.int64), np.array(list(map(len, found)), np.int64)
        raw = [(" " + p).encode("utf-8", "surrogatepass") for p in new]
        size = np.array(list(map(len, raw)), np.int64)
        of = [np.repeat(np.arange(len(new)), n) for n in (n_a, n_b)]
        ok = np.ones(len(new), bool)
        for ids, n, table, lens, owner in ((ids_a, n_a, self.bytes_a, self.len_a, of[0]), (ids_b, n_b, self.bytes_b, self.len_b, of[1])):
            ok &= np.bincount(owner, lens[ids], len(new)).astype(np.int64) == size
            joined = b"".join(map(table.__getitem__, ids.tolist()))
            if joined != b"".join(raw):
                ends, at = np.cumsum(n), np.concatenate([[0], np.cumsum(lens[ids])])
                starts = ends - n
                ok &= [joined[at[s] : at[e]] == r for s, e, r in zip(starts, ends, raw)]
        keep_a, keep_b = ok[of[0]], ok[of[1]]
        ids_a, ids_b, of = ids_a[keep_a], ids_b[keep_b], [of[0][keep_a], of[1][keep_b]]
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        # Groups: ends that both have.
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        words_a, words_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        text, s, t = [], 0, 0
        for i, j in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            text.append(f"{words_a[s]}|{words_b[t]}" if i == s + 1 and j == t + 1 else f"{','.join(words_a[s:i])}|{','.join(words_b[t:j])}")
            s, t = i, j
        owner = of[0][last_a]
        n_groups = np.bincount(owner, minlength=len(new))
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        # Links: B tokens from the one that ends after an A token's start to the one that begins before its end.
        first = np.searchsorted(end_b, end_a - self.len_a[ids_a], "right")
        count = np.searchsorted(end_b - self.len_b[ids_b], end_a, "left") - first
        left = np.repeat(np.arange(len(ids_a)), count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + first[left]
        pairs = (ids_a[left] << SHIFT) | ids_b[right]
        n_links = np.bincount(of[0][left], minlength=len(new))
        base = len(self.groups)
        self.number.update(zip(new, range(base, base + len(new))))
        self.groups += [";".join(text[i:j]) for i, j in zip(at, at[1:])]
        self.parts.append(np.stack([ok, n_a * ok, n_b * ok, n_groups, n_links], 1).astype(np.int64))
        self.links.append(pairs)
        self._table = None
        self.held += 350 * len(new) + 2 * int(size.sum()) + 16 * len(pairs)

    def table(self):
        if self._table is None:
            self.parts, self.links = [np.concatenate(self.parts)], [np.concatenate(self.links)]
            ends = np.cumsum(self.parts[0][:, 4])
            self._table = self.parts[0], self.links[0], ends - self.parts[0][:, 4]
        return self._table

    def measure(self, texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Per text: counts, hash of the groups, distinct pairs and their links."""
        if self.held > self.most:
            self.clear()
        parts = [self.pieces(t) for t in texts]
        new = set().union(*parts).difference(self.number)
        if new:
            self.learn(list(new))
        sums, links, starts = self.table()
        nothing = [0, 0, 0, 0], "", np.empty(0, np.int64), np.empty(0, np.int64)
        for part in parts:
            idx = np.fromiter(map(self.number.__getitem__, part), np.int64, len(part))
            rows = sums[idx]
            if not rows[:, 0].all():
                yield nothing
                continue
            sha = hashlib.sha256(";".join(map(self.groups.__getitem__, idx.tolist())).encode()).hexdigest()
            n = rows[:, 4]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[idx], n)
            pairs, times = np.unique(links[at], return_counts=True)
            yield rows[:, 1:].sum(0).tolist(), sha, pairs, times


@functools.lru_cache(maxsize=1)
def kept_aligned(path_a: str, path_b: str) -> Aligned:
    """The pieces that a worker keeps from task to task, ``KEPT`` bytes at most."""
    return Aligned(path_a, path_b)


def digest_of(col: str):
    return F.unhex(F.sha2(F.col(col), 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """One row per distinct text with tokens: its digest, the documents that
    have it, its counts, its pairs of ids and how many links each has."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n_docs"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = kept_aligned(path_a, path_b)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = list(both.measure(part.column("text").to_pylist()))
                ends = np.concatenate([[0], np.cumsum([len(x[2]) for x in found])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in found]).astype(kind))) for k, kind in ((2, np.int64), (3, np.int32))]
                counts = [pa.array([x[0][k] for x in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("n_docs"), *counts, pa.array([x[1] for x in found], pa.string()), *lists], ["digest", "n_docs", *COUNTS, "groups_sha256", "pairs", "times"])
        slim()

    return written(texts.withColumn("digest", digest_of("text")).mapInArrow(align, MEASURES), "aligned")


def pair_counts(measures: DataFrame) -> DataFrame:
    """Links of each pair of ids in the whole corpus, and whether no A id has
    more links with its B id."""
    rows = measures.select("n_docs", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.times") * F.col("n_docs")).alias("links"))
    counts = written(counts, "pairs")
    id_b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    top = counts.groupBy(id_b.alias("b")).agg(F.max("links").alias("top"))  # one row an entry of B
    return counts.join(top, id_b == top.b).select("pair", "links", (F.col("links") == F.col("top")).alias("best"))


def weighed(measures: DataFrame, counts: DataFrame, most: int = MOST) -> DataFrame:
    """n_best and count_sum of each distinct text, by digest."""
    spark = measures.sparkSession
    n = counts.count()
    if n <= most:
        rows = counts.toArrow()
        order = np.argsort(rows.column("pair").to_numpy())
        keys, links, best = (rows.column(c).to_numpy()[order] for c in ("pair", "links", "best"))
        shared = spark.sparkContext.broadcast((keys, links, best))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, links, best = shared.value
            for batch in batches:
                pairs, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
                size = batch.column("pairs").value_lengths().to_numpy()
                at, ends = np.searchsorted(keys, pairs), np.concatenate([[0], np.cumsum(size)])
                out = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (best[at] * times, links[at] * times)]
                yield pa.RecordBatch.from_arrays([batch.column("digest"), *map(pa.array, out)], ["digest", "n_best", "count_sum"])

        return measures.select("digest", "pairs", "times").mapInArrow(weigh, "digest binary, n_best long, count_sum long")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS))
    rows = measures.select("digest", salt.alias("salt"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("digest", "salt", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    slots = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    return rows.join(slots, ["pair", "salt"]).groupBy("digest").agg(F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per document: its counts of tokens, groups and links, how many
    links are their B id's most frequent, the sum of their counts, and the
    hash of its groups."""
    measures = aligned_texts(docs, path_a, path_b, text_col)
    totals = weighed(measures, pair_counts(measures), most)
    groups = measures.drop("pairs", "times").join(totals, "digest", "left")
    groups = written(groups, "measures")
    rows = docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"))
    out = hot_join(rows, groups, "digest", "n_docs")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "n_best", "count_sum")]
    return out.select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
