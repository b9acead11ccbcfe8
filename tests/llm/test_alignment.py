"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from segq.llm import alignment, registry

A, B = registry.tokenizer_path(), registry.tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, digest string, n_docs long, pair long"


def by_force(rows):
    """Whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    of_a, of_b = alignment.byte_tokens(A), alignment.piece_tokens(model)
    per, total = [], Counter()
    for i, text in rows:
        if not text:
            per.append((i, None))
            continue
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        raw = (" " + text).encode()
        if b"".join(of_a[x] for x in a) != raw or b"".join(of_b[x] for x in b) != raw:
            per.append((i, None))
            continue
        spans = []
        for ids, of in ((a, of_a), (b, of_b)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(of[x]), x))
                at += len(of[x])
            spans.append(out)
        links = [(x, y) for s, e, x in spans[0] for s2, e2, y in spans[1] if s < e2 and s2 < e]
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [";".join("|".join(",".join(str(x) for _, e, x in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *both], both))]
        total.update(links)
        per.append((i, (len(a), len(b), len(both), links, hashlib.sha256(groups[0].encode()).hexdigest())))
    top = Counter()
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    out = []
    for i, x in per:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[3]
            out.append((i, x[0], x[1], x[2], len(links), sum(total[p] == top[p[1]] for p in links), sum(total[p] for p in links), x[4]))
    return sorted(out, key=str)


def texts():
    rng = random.Random(5)
    words = ["alpha", "don't", "naïve", "日本語テキスト", "x=1,", "\n", "\t", " ", "  ", "▁", "<|endoftext|>", "</s>", "<0x41>", "\x00", "end.\n", "🙂🙂", " ", "Ünïcode", "12345", "…", "ﬁ", "Ａ"]
    out = ["", None, " ", "  a ", "\n\n x", "a", "▁", "x" * 3000, "日本" * 400]
    out += [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    return out + ["said the cat on the mat"] * 40


@pytest.mark.parametrize("most", [1 << 22, 10])
def test_alignment_is_that_of_whole_texts(spark, most):
    rows = [(k % 150 if k % 31 else None, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = alignment.align(docs, A, B, most=most)
    want = by_force(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] > 0 for r in want) > 100


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    empty = alignment.align(spark.createDataFrame([(1, None, "", 1, 1), (None, "", "", 1, 1)], SCHEMA), A, B).collect()
    assert [(r.n_a, r.groups_sha256) for r in empty] == [(0, ""), (0, "")]


def test_pieces_that_are_forgotten_give_the_same(spark):
    some = [t for t in texts() if t]
    large, small = alignment.Aligned(A, B), alignment.Aligned(A, B, most=0)
    for t in some:
        (one,), (two,) = large.measure([t]), small.measure([t])
        assert one[:2] == two[:2] and (one[2] == two[2]).all() and (one[3] == two[3]).all()
