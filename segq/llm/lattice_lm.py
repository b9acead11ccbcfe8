"""Language-model scoring by subword lattice likelihood.

An existing subword vocabulary supplies pieces and scores; a word's lattice
has one arc for every piece that fits (single bytes fit everywhere), and the
forward recursion, in log space, sums over all segmentations, whatever the
word's length.  No public vocabulary of the unigram kind is at hand: the one
used is a byte-pair vocabulary whose scores are merge ranks, so piece weights
start as a Zipf law of the ranks and are re-estimated by expectation
maximisation over every training word with its count, until a step betters
the likelihood by less than ``TOLERANCE`` (at most ``STEPS`` steps).

Words seen in training are arcs too, over the whole word.  The end token is an
arc of its own.  With lattice L, N training tokens and V distinct ones, and
likewise per class k of documents (the values of ``class_col``, such as the
language; one class without it)

    P(w) = (c(w) + V L(w)) / (N + V)
    P_k(w) = (c_k(w) + V_k P(w)) / (N_k + V_k)
    P(text) = sum over k of share_k * product of P_k(token)

so a text's own class is never an input: the sum runs over all.  The
``CLASSES`` - 1 classes with most training documents stand for themselves, all
others are one more.

Data flow: a task cuts its documents into chunks and writes (a) the documents
as word numbers and counts and (b) the chunk's distinct words, sorted, dealt
to buckets by hash.  Buckets are merged in parallel and written once; each
step of the estimation reads them and returns one vector of the vocabulary's
size a group of buckets, and one more pass scores each distinct word; the
scores go back to their chunks.  Text is read once and never shuffled, and
what is gathered grows with the distinct words.

Defined results: null and empty texts are the end token alone; a null id
counts as training (crc32 of the empty text); repeated rows all count; an
empty table gives no rows; no training rows give N = V = 0 and lattice
probabilities alone; a null class is a class.  Words are never cut.
"""

import itertools
import math
import uuid
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segq.llm.common import drop, free, partitions, slim, text_of, tune, written

CHUNK_BYTES, BATCH_BYTES, HELD_OUT, FOLDS, STEPS, TOLERANCE, CLASSES = 6 << 20, 1 << 18, 2, 7, 4, 2e-3, 8
MARK = "▁".encode()


class Pieces:
    """Arcs of the lattice: distinct byte strings with log probabilities.

    A single byte's arc is its piece, if it is one, and its byte token in one."""

    def __init__(self, weights: dict[bytes, float], end: float):
        self.strings = sorted(weights)
        total = sum(weights.values()) + end
        self.logs = np.log(np.array([weights[s] for s in self.strings]) / total)
        self.lens = np.array([len(s) for s in self.strings])
        self.end = end / total
        self.finder = None

    @classmethod
    def from_vocabulary(cls, path: str) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        weights = dict.fromkeys((bytes([b]) for b in range(256)), 1e-9)
        for i in range(sp.get_piece_size()):
            weight = 1.0 / (10.0 - min(0.0, sp.get_score(i)))
            if sp.is_byte(i):
                weights[bytes([int(sp.id_to_piece(i)[1:-1], 16)])] += weight * 1e-3
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i).encode()
                weights[piece] = weights.get(piece, 0.0) + weight
        return cls(weights, 0.01)

    def __getstate__(self):
        return self.__dict__ | {"finder": None}

    def arcs(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(end, arc) of every piece in the text, by ascending end."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, s in enumerate(self.strings):
                self.finder.add_word(s.decode("latin-1"), i)
            self.finder.make_automaton()
        flat = np.fromiter(itertools.chain.from_iterable(self.finder.iter(text.decode("latin-1"))), np.int64)
        return flat[::2] + 1, flat[1::2]

    def lattices(self, words: list[bytes]):
        """(places in ``words``, Lattices) of batches of words of like length."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        begin, size = 0, 0
        for k, i in enumerate(order):
            size += len(words[i])
            if size >= BATCH_BYTES or k + 1 == len(order):
                yield order[begin : k + 1], Lattices(self, [words[j] for j in order[begin : k + 1]])
                begin, size = k + 1, 0

    def forward(self, words: list[bytes]) -> np.ndarray:
        """log10 of the marginal probability of each word over segmentations."""
        out = np.zeros(len(words))
        for places, lattices in self.lattices(words):
            out[places] = lattices.forward()[lattices.last] / math.log(10)
        return out

    def expect(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each arc, and last the log likelihood."""
        uses = np.zeros(len(self.strings) + 1)
        for places, lattices in self.lattices(words):
            lattices.expect(counts[places].astype(float), uses)
        return uses

    def refit(self, uses: np.ndarray, ends: float) -> "Pieces":
        """Weights from expected uses, smoothed by the weights before (as much
        as one thousandth of the uses)."""
        prior = 1.0 + 1e-3 * (uses.sum() + ends)
        return Pieces(dict(zip(self.strings, (prior * np.exp(self.logs) + uses).tolist())), ends + prior * self.end)


class Lattices:
    """The lattices of some words, side by side: nodes are byte places."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        marked = [MARK + w for w in words]
        lens = np.array([len(w) for w in marked])
        self.first = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])  # a line feed parts words; none holds one
        self.last = self.first + lens
        self.n = int(self.last[-1]) + 1
        self.end, self.arc = pieces.arcs(b"\n".join(marked))
        word = np.searchsorted(self.first, self.end - 1, "right") - 1
        inside = self.end <= self.last[word]
        self.end, self.arc, self.word = self.end[inside], self.arc[inside], word[inside]
        self.start, self.log = self.end - pieces.lens[self.arc], pieces.logs[self.arc]

    @staticmethod
    def _sums(into: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
        """into[a] = log of the sum of exp(x) over the rows with at == a, whose
        values stand side by side."""
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        top = np.maximum.reduceat(x, edges)
        total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(edges, len(x))))), edges)
        into[at[edges]] = top + np.log(total)

    def forward(self) -> np.ndarray:
        alpha = np.full(self.n, -np.inf)
        alpha[self.first] = 0.0
        depth = self.end - self.first[self.word]
        order = np.argsort(depth, kind="stable")  # ends stay side by side
        edges = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
        start, end, log = self.start[order], self.end[order], self.log[order]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self._sums(alpha, end[lo:hi], alpha[start[lo:hi]] + log[lo:hi])
        return alpha

    def backward(self) -> np.ndarray:
        beta = np.full(self.n, -np.inf)
        beta[self.last] = 0.0
        depth = self.last[self.word] - self.start
        order = np.lexsort((self.start, depth))
        edges = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
        start, end, log = self.start[order], self.end[order], self.log[order]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self._sums(beta, start[lo:hi], beta[end[lo:hi]] + log[lo:hi])
        return beta

    def expect(self, counts: np.ndarray, uses: np.ndarray) -> None:
        alpha, beta = self.forward(), self.backward()
        total = alpha[self.last]
        share = np.exp(alpha[self.start] + self.log + beta[self.end] - total[self.word]) * counts[self.word]
        uses[:-1] += np.bincount(self.arc, share, len(uses) - 1)
        uses[-1] += float((total * counts).sum())


def _pack(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


CHUNKS = "chunk string, bucket int, first long, words binary, counts binary, ids binary, no_id binary, sizes binary, numbers binary, times binary"


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _chunks(n_buckets: int, n_classes: int):
    """Rows of chunks (bucket -1: the documents) and of their words, with one
    row of counts a class."""
    def made(docs):
        zip_ = zstandard.ZstdCompressor(level=1)
        number: dict[bytes, int] = {}
        sizes, numbers, times = [], [], []
        kinds = np.array([-1 if is_held_out(d) else k for d, k, _ in docs])
        for _, _, words in docs:
            sizes.append(len(words))
            numbers.extend([number.setdefault(w, len(number)) for w in words])
            times.extend(words.values())
        words, numbers, times = list(number), np.array(numbers, np.int64), np.array(times, np.int64)
        kind = np.repeat(kinds, sizes)
        seen = np.stack([np.bincount(numbers[kind == k], times[kind == k], len(words)) for k in range(n_classes)]).astype("<u4")
        dealt = [[] for _ in range(n_buckets)]
        for i, w in enumerate(words):
            dealt[zlib.crc32(w) % n_buckets].append(i)
        for part in dealt:
            part.sort(key=words.__getitem__)
        order = np.array([i for part in dealt for i in part], np.int64)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        chunk, ids = uuid.uuid4().hex, [d for d, _, _ in docs]
        head = {"chunk": chunk, "bucket": -1, "first": len(words), "words": None, "counts": None, "ids": _pack(np.array([d or 0 for d in ids], "<i8")), "no_id": _pack(np.array([d is None for d in ids], np.uint8)),
                "sizes": _pack(np.array(sizes, "<u4")), "numbers": _pack(place[numbers].astype("<u4")), "times": _pack(times.astype("<u4"))}
        rows, at = [head], 0
        blank = dict.fromkeys(head)
        for b, part in enumerate(dealt):
            if part:
                rows.append(blank | {"chunk": chunk, "bucket": b, "first": at, "words": zip_.compress(b"\n".join([words[i] for i in part])), "counts": _pack(seen[:, part].ravel())})
                at += len(part)
        return pd.DataFrame(rows)

    def run(batches):
        docs, size = [], 0
        for pdf in batches:
            for doc_id, kind, text in zip(pdf["doc_id"], pdf["kind"].tolist(), pdf["text"]):
                raw = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
                docs.append((None if pd.isna(doc_id) else int(doc_id), kind, Counter(raw.split())))
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield made(docs)
                    docs, size = [], 0
        if docs:
            yield made(docs)
        slim()

    return run


def _words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def _merged(pdf: pd.DataFrame, n_classes: int) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Distinct words of a bucket, their counts by class, and the numbers of
    the words of each row."""
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in _words(blob)], np.int64) for blob in pdf["words"]]
    total = np.zeros((n_classes, len(number)), np.int64)
    for at, counts in zip(rows, pdf["counts"]):
        total[:, at] += _unpack(counts, "<u4").reshape(n_classes, -1)
    return list(number), total, rows


def classes_of(docs: DataFrame, class_col: str | None, most: int) -> tuple:
    """Column of the class number, and the classes' training documents."""
    if class_col is None:
        return F.lit(0), 1
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    name = F.coalesce(F.concat(F.lit("c"), F.col(class_col).cast("string")), F.lit("n"))
    top = [r["name"] for r in docs.filter(crc != HELD_OUT).groupBy(name.alias("name")).count().orderBy(F.desc("count"), "name").limit(most - 1).collect()]
    kind = F.lit(len(top))
    for i, x in enumerate(top):
        kind = F.when(name == x, i).otherwise(kind)
    return kind, len(top) + 1


def lattice_lm(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, steps: int = STEPS, classes: int = CLASSES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), *([F.col(class_col).alias("class")] if class_col else []))
    kind, n_classes = classes_of(rows, "class" if class_col else None, classes)
    sizes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(24, 2 * partitions(spark), 2 * math.isqrt(sizes >> 20))
    chunks = written(rows.select("doc_id", "text", kind.alias("kind")).mapInPandas(_chunks(n_buckets, n_classes), CHUNKS), "chunks")
    # Dealt out by number: their bytes are few, their work is not.
    words = chunks.filter("bucket >= 0").select("chunk", "bucket", "first", "words", "counts").repartition(n_buckets, "bucket")

    def distinct(pdf: pd.DataFrame) -> pd.DataFrame:
        names, total, _ = _merged(pdf, n_classes)
        known = np.flatnonzero(total.sum(0))
        blob = zstandard.ZstdCompressor(level=1).compress(b"\n".join([names[i] for i in known]))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "n": [len(known)], "words": [blob], "counts": [_pack(total.sum(0)[known])], "tokens": [total.sum(1)], "types": [(total > 0).sum(1)]})

    merged = written(words.groupBy("bucket").applyInPandas(distinct, "bucket int, n long, words binary, counts binary, tokens array<long>, types array<long>"), "words")
    trained = rows.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT)
    ends = np.zeros(n_classes, np.int64)  # training documents by class
    for r in trained.groupBy(kind.alias("kind")).count().collect():
        ends[r["kind"]] = r["count"]
    tokens, types = ends.copy(), (ends > 0).astype(np.int64)
    sums = merged.select(*(F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("tokens", "types") for k in range(n_classes)), F.sum("n").alias("n")).first()
    for k in range(n_classes):
        tokens[k] += sums[f"tokens{k}"] or 0
        types[k] += sums[f"types{k}"] or 0
    n_train = int(ends.sum())
    all_tokens, all_types = int(tokens.sum()), int(sums["n"] or 0) + (n_train > 0)

    groups, pieces, before = math.isqrt(n_buckets), Pieces.from_vocabulary(vocabulary), -math.inf
    for _ in range(steps if sums["n"] else 0):
        shared = spark.sparkContext.broadcast(pieces)

        def expected(pdf: pd.DataFrame) -> pd.DataFrame:
            uses = sum(shared.value.expect(_words(w), _unpack(c, "<i8")) for w, c in zip(pdf["words"], pdf["counts"]))
            return pd.DataFrame({"group": [int(pdf["bucket"].iloc[0]) % groups], "uses": [_pack(uses)]})

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"group": pdf["group"].iloc[:1], "uses": [_pack(sum(_unpack(blob, "<f8") for blob in pdf.sort_values("uses")["uses"]))]})

        # Vectors of the vocabulary's size are added in two steps.
        part = merged.filter("n > 0").repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(expected, "group int, uses binary").groupBy("group").applyInPandas(summed, "group int, uses binary")
        uses = sum(_unpack(bytes(blob), "<f8") for blob in part.toPandas().sort_values("group")["uses"])
        free(shared)
        pieces, now = pieces.refit(uses[:-1], float(n_train)), float(uses[-1])
        if now - before < TOLERANCE * abs(now):
            break
        before = now
    drop(merged)
    model = spark.sparkContext.broadcast(pieces)

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        names, total, rows = _merged(pdf, n_classes)
        logs = model.value.forward(names)
        return pd.DataFrame({"chunk": pdf["chunk"], "first": pdf["first"], "counts": [_pack(total[:, at].ravel()) for at in rows], "logs": [_pack(logs[at]) for at in rows]})

    scores = words.groupBy("bucket").applyInPandas(scored, "chunk string, first long, counts binary, logs binary")
    own_classes = np.flatnonzero(ends)

    def mix(c, logs, n, v):
        """log10 of (c + v 10**logs) / (n + v), also where that underflows."""
        if not n:
            return logs
        return np.where(c > 0, np.log10(c + v * 10.0 ** np.maximum(logs, -300)), math.log10(v) + logs) - math.log10(n + v)

    def finished(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc in left.itertuples():
            c, logs = np.zeros((n_classes, doc.first), np.int64), np.zeros(doc.first)
            for part in right.itertuples():
                got = _unpack(part.counts, "<i8").reshape(n_classes, -1)
                c[:, part.first : part.first + got.shape[1]] = got
                logs[part.first : part.first + got.shape[1]] = _unpack(part.logs, "<f8")
            numbers, times, sizes = _unpack(doc.numbers, "<u4").astype(np.int64), _unpack(doc.times, "<u4").astype(np.int64), _unpack(doc.sizes, "<u4").astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])

            def add(x):
                total = np.concatenate([[0], np.cumsum(x)])
                return total[edges[1:]] - total[edges[:-1]]

            every = c.sum(0)
            base = np.log10((every + 1) / (all_tokens + all_types + 1))
            whole = mix(every, logs, all_tokens, all_types)
            end = mix(np.array([n_train]), np.log10([model.value.end]), all_tokens, all_types)
            if len(own_classes):
                parts = [add(times * mix(c[k], whole, tokens[k], types[k])[numbers]) + mix(ends[k : k + 1], end, tokens[k], types[k])[0] + math.log10(ends[k] / n_train) for k in own_classes]
                top = np.max(parts, 0)
                score = top + np.log10(np.sum([10.0 ** (p - top) for p in parts], 0))
            else:
                score = add(times * whole[numbers]) + end[0]
            ids = [None if none else int(i) for i, none in zip(_unpack(doc.ids, "<i8"), _unpack(doc.no_id, "u1"))]
            out.append(pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"), "held_out": [is_held_out(i) for i in ids],
                "n_tokens": add(times) + 1, "n_known": add(times * (every[numbers] > 0)) + int(n_train > 0), "train_tokens": all_tokens,
                "base_score": add(times * base[numbers]) + math.log10((n_train + 1) / (all_tokens + all_types + 1)), "score": score,
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    heads = chunks.filter("bucket < 0").select("chunk", "first", "ids", "no_id", "sizes", "numbers", "times")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return heads.groupBy("chunk").cogroup(scores.groupBy("chunk")).applyInPandas(finished, schema)
