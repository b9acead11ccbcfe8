"""Nulls, empty and repeated rows, empty tables and clashing columns for every
operator and every stage, and brute-force versions on small fixtures."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest

from segq.llm import decontaminate, exact_dedup, html_text, lattice_lm, line_dedup, mixing, ngram_join, registry, suffix_dedup, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 120))) for _ in range(n // 3)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(len(base), n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "É à " * 40), (None, base[0]), (n + 4, base[0]), (n + 4, base[0]), (n + 5, "x" * 5000)]
    return [(i, t, None, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 4}", len(t or ""), 0.5, 1, "k") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    assert len(got) == docs.count() and exact_dedup.exact_dedup(none).count() == 0
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None) and r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_heavy_and_light_paths_agree(docs):
    key = lambda r: (r.doc_id or -1, r.text_sha256)
    one, two = (sorted(exact_dedup.exact_dedup(docs, counters=c).collect(), key=key) for c in (2, 8192))
    assert one == two


def test_line_dedup(spark):
    page = lambda i, own: (i, "http://a.org/x", f"<nav>menu</nav><p>{own}</p><p>note</p>")
    rows = [page(i, f"text {i}") for i in range(8)] + [(90, None, None), (91, "http://b.org", "<p>menu</p><p>own</p>"), (92, "http://c.org", "<p>menu</p>"), (92, "http://c.org", "<p>menu</p>"), (93, "http://c.org", "<p>left</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = line_dedup.line_dedup(pages).collect()
    assert {r.text for r in plain if r.host == "a.org"} == {f"text {i}" for i in range(8)}
    assert sorted(r.text for r in plain if r.page_id in (90, 91)) == ["", "menu\nown"]
    assert sorted((r.page_id, r.text) for r in plain if r.host == "c.org") == [(92, ""), (92, ""), (93, "left")]
    salted = line_dedup.line_dedup(pages, broadcast_lines=-1)
    assert sorted(map(tuple, plain)) == sorted(map(tuple, salted.collect()))
    assert line_dedup.line_dedup(pages.limit(0)).count() == 0


def test_decontamination(spark, docs, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    long_ = next(r.text for r in docs.collect() if len((r.text or "").split()) > 40)
    items = [(1, " ".join(long_.split()[5:25])), (2, "alpha1 beta2"), (3, None), (4, "..."), (None, long_), (1, long_[:50])]
    want = {}
    windows = [(str(i) if i is not None else "", words(t)) for i, t in items]
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for item, v in windows:
            k = min(13, len(v))
            spans = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if k else set()
            for a in range(len(w) - k + 1 if k else 0):
                if tuple(w[a : a + k]) in spans:
                    hit |= set(range(a, a + k))
                    found.add(item)
        want.setdefault((r.doc_id, r.text), (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    for size in (1 << 24, 40):  # broadcast, and joined in several parts
        got = decontaminate.decontamination(docs, bench(spark, items), most=size).select("doc_id", "text", "hits.*").collect()
        assert all(want[r.doc_id, r.text] == tuple(r)[2:] for r in got) and len(got) == docs.count()
    assert decontaminate.decontamination(none, bench(spark, [])).count() == 0
    assert not decontaminate.decontamination(docs, bench(spark, [])).filter("hits.contaminated").count()


def linked_by_force(rows):
    """Shingle sets by id, and a function from id to component."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, find


def test_ngram_join(docs, none):
    rows = docs.collect()
    sets, find = linked_by_force([(r.doc_id, r.text) for r in rows])
    got = ngram_join.ngram_join(docs).collect()
    assert len(got) == len(rows) and ngram_join.ngram_join(none).count() == 0
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == (None if r.doc_id is None else find(r.doc_id))


def test_ngram_join_of_families_in_blocks(spark, monkeypatch):
    """Texts that share entries without all being linked: several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    asked = []
    across = ngram_join._across
    monkeypatch.setattr(ngram_join, "_across", lambda left, exact: asked.append(left.select("node").distinct().count()) or across(left, exact))
    rng, rows = random.Random(7), []
    base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(140)]
    texts = [base]
    for i in range(120):
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(2, 8)):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(9)}"
        texts.append(words)
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    sets, find = linked_by_force(rows)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert asked[0] > 4
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), find(i)) for i, _ in rows}


def test_suffix_dedup(docs, none):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    seen = {}
    for r in rows:
        b = (r.text or "").encode()
        for i in range(len(b) - 49):
            key = -1 if r.doc_id is None else r.doc_id
            seen[b[i : i + 50]] = min(key, seen.get(b[i : i + 50], key))
    want = {}
    for r in rows:
        b, key = (r.text or "").encode(), -1 if r.doc_id is None else r.doc_id
        mark = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < key:
                mark[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mark) if not m)
        want[r.doc_id, r.text] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, *want[r.doc_id, r.text]) for r in rows)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_lattice_lm_base_and_forward(docs, none):
    rows = docs.collect()
    toks = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = {}
    for r in rows:
        for w in toks(r.text) if not held(r.doc_id) else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id or -1, len(toks(r.text)), sum(w in counts for w in toks(r.text)), round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in toks(r.text)), 6)) for r in rows)
    path = registry.tokenizer_path("piece_bpe_32k.model")
    got = lattice_lm.lattice_lm(docs, path).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got) and lattice_lm.lattice_lm(none, path).count() == 0
    pieces = lattice_lm.Pieces.from_vocabulary(path)
    probs = dict(zip(pieces.strings, np.exp(pieces.logs)))
    words = [b"the", b"erting", b"\xc3\xa9t", b"a", b"the"]
    assert np.allclose(10 ** pieces.forward(words), [spelled(probs, w) for w in words], rtol=1e-9)
    uses = pieces.expect(words, np.array([1, 2, 3, 4, 5]))
    for piece in (b"er", b"\xe2\x96\x81the", b"h", b"ing"):
        with_more = dict(probs)
        with_more[piece] *= 1 + 1e-6  # expected uses are the slope of the log likelihood by the log weight
        slope = sum(c * (math.log(spelled(with_more, w)) - math.log(spelled(probs, w))) for w, c in zip(words, [1, 2, 3, 4, 5])) / 1e-6
        assert math.isclose(uses[pieces.strings.index(piece)], slope, abs_tol=1e-4)
    assert abs(float(pieces.forward([b"ab" * 9000])[0]) / 9000 - float(pieces.forward([b"ab" * 900])[0]) / 900) < 0.1


def spelled(probs, word):
    """Probability of a word by summing over all its segmentations."""
    def every(text):
        return 1.0 if not text else sum(probs[text[:k]] * every(text[k:]) for k in range(1, len(text) + 1) if text[:k] in probs)

    return every(lattice_lm.MARK + word)


def test_lattice_lm_score_by_force(spark):
    """The whole score from a plain version of the model: classes, whole-word
    arcs, lattice and end."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("le chat noir", "fr"), ("the dog", "en"), (None, None), ("un chat", "fr"), ("the the xyz", "en"), ("A b", "de")] * 3)]
    path = registry.tokenizer_path("piece_bpe_32k.model")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lattice_lm.lattice_lm(table, path, class_col="lang", steps=0).collect()}
    pieces = lattice_lm.Pieces.from_vocabulary(path)
    probs, tokens_of = dict(zip(pieces.strings, np.exp(pieces.logs))), lambda t: (t or "").lower().encode().split() + [None]
    train = [(lang, tokens_of(t)) for i, t, lang in rows if not lattice_lm.is_held_out(i)]
    count = lambda docs: {w: sum(d.count(w) for d in docs) for w in {w for d in docs for w in d}}
    whole, by_class = count([d for _, d in train]), {k: count([d for x, d in train if x == k]) for k in {x for x, _ in train}}

    def p(w, counts, below):
        n, v = sum(counts.values()), len(counts)
        return (counts.get(w, 0) + v * below(w)) / (n + v)

    first = lambda w: p(w, whole, lambda x: pieces.end if x is None else spelled(probs, x))
    for i, t, _ in rows:
        want = sum(sum(x == k for x, _ in train) / len(train) * math.prod(p(w, c, first) for w in tokens_of(t)) for k, c in by_class.items())
        assert math.isclose(got[i].score, math.log10(want), rel_tol=1e-9) and got[i].held_out == lattice_lm.is_held_out(i)


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(none).count() == 0
    total, per = sum(r["size"] for r in got), {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        per.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert math.isclose(sum(t for t, _ in per.values()), total)
    assert all(abs(t - n) <= max(3, 0.02 * t) for t, n in per.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert set(mixing.mixed(docs).columns) == set(docs.columns)


def test_knapsack_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes, counts = rng.integers(1, 12, 4), rng.integers(0, 4, 4)
        budget = int(rng.integers(0, 60))
        take = mixing.knapsack(sizes, counts, budget)
        best = max(s for s in (sum(a * b for a, b in zip(t, sizes)) for t in np.ndindex(*(counts + 1))) if s <= budget)
        assert (take <= counts).all() and int((take * sizes).sum()) == best


def test_token_files(docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    at = 0
    want = []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_files(docs, path, f"file://{tmp_path}/t").orderBy("start").collect()]
    assert got == want and token_files.token_files(none, path).count() == 0


def test_encoder_equals_whole_texts():
    texts = ["", " ", "a  b\n\n c\t", "it's  we'll <|endoftext|> É1 x²\u00a0\u2003 y", "中文 mixed 123abc!?  ", "\r\n  end   ", "A.\nB, c!\n\nd?\ne's x_y__ 7), ²."] + [r[1] or "" for r in corpus()]
    tok = token_files.load_tokenizer(registry.tokenizer_path())
    assert [x.tolist() for x in token_files.Encoder(registry.tokenizer_path()).encode(texts)] == [c.ids for c in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_file_reads_only_what_is_asked_and_verifies():
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out, 2, frame_ids=100)
    docs = {i: np.arange(i, i + 60) for i in range(20)}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()
    reader = token_files.TokenFileReader(io.BytesIO(out.getvalue()))
    assert [(i, x.tolist()) for i, x in reader.documents([3, 17])] == [(i, docs[i].tolist()) for i in (3, 17)]
    broken = bytearray(out.getvalue())
    broken[int(reader.ends[0]) - 1] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_files.TokenFileReader(io.BytesIO(bytes(broken))).frame(0)


def test_toxicity(spark, docs, none):
    rows = [(i, f"{w} words of plain {i}" + (" idiot" if i % 4 == 0 else ""), None, None, 0, 0.1, 1, "k") for i, w in enumerate(WORDS * 20)]
    table = spark.createDataFrame(rows + [(None, None, None, None, None, None, None, None), (5, "again", None, None, 0, 0.1, 1, "k")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id != 5)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted([10 * a + 5, 100 * b + 200, 1000 + int(rng.integers(50))])))
        y.append(int(a and b))
    model = toxicity.fit(rows, np.array(y), epochs=30)
    slot = model.slot
    pair = lambda *p: float(np.dot(model.factors[slot[p[0]]], model.factors[slot[p[1]]]))
    assert pair(15, 300) > 0


PAGE = '<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies on the site and you agree</div><article><h1>Head &amp; line</h1><p>Some  text of the\n article.</p><p>Short</p></article><div id="comments"><p>I liked the article and the text of it</p></div><footer>&copy; me</footer></body></html>'


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "the cat is on the mat and it was " * 5 + "<p>tail of <b>the</b> text")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.html_text(pages).collect()}
    assert got[1].text == "Head & line\nSome text of the article.\nShort" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and "the cat is on" in got[4].text


def test_pipeline_stages_on_edges(spark, docs, tmp_path):
    import corpus_pipeline

    bench(spark, [(1, "alpha1 beta2 gamma3"), (None, None)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (None, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs.select("doc_id", "text", "lang", "source", "n_chars"), docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == table.columns
            out.count()
