import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from ragloom.llm import lm

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def brute(rows):
    c = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def corpus():
    r = random.Random(2)
    vocab = ["the", "The", "of", "and", "Élan", "thing.", "ß"] + ["w%d" % i for i in range(200)]
    rows = [(i, r.choice([" ", "\n", " \t"]).join(r.choices(vocab, [50, 9, 30, 30, 5, 5, 5] + [1] * 200, k=r.randrange(0, 90)))) for i in range(200)]
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "only here"), (903, "only here"), (None, "nobody"), (905, "the of and " * 3000)]


def test_scores(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, score string").repartition(3)
    model = lm.fit(df, PATH, P.PATTERN)
    got = lm.score(df, model, PATH, P.PATTERN).collect()
    key = lambda x: (str(x[0]), x[1], round(x[4], 6))
    want = sorted(brute(rows), key=key)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [x[:4] for x in mine] == [x[:4] for x in want]
    assert all(a[4] == pytest.approx(b[4], rel=1e-9) for a, b in zip(mine, want, strict=True))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got if r.doc_id is not None)
    assert all(r.score < 0 for r in got) and [r.held_out for r in got if r.doc_id is None] == [None]
    empty = lm.score(df.limit(0), lm.fit(df.limit(0), PATH, P.PATTERN), PATH, P.PATTERN)
    assert empty.collect() == []


def test_gradients():
    m = lm.Attention(300)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    x, y, on = r.integers(0, 300, (3, lm.WINDOW)), r.integers(0, m.classes, (3, lm.WINDOW)), r.random((3, lm.WINDOW)) < 0.8
    _, g = m.loss(x, y, on)
    for name, v in m.p.items():
        for i in np.argsort(-np.abs(g[name]).ravel())[:3]:
            at = np.unravel_index(i, v.shape)
            old = v[at]
            v[at] = old + 1e-5
            up = m.loss(x, y, on)[0]
            v[at] = old - 1e-5
            down = m.loss(x, y, on)[0]
            v[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6


def test_windows_score_each_once_and_causally():
    m = lm.Attention(50, np.arange(51))
    r = np.random.default_rng(3)
    off = np.array([0, 1, 17, 33, 34, 134])
    ids = r.integers(0, 50, 134)
    at, on = m.windows(ids, off)
    assert sorted(at[on].tolist()) == list(range(134))
    whole = m.score(ids, off)
    for k in range(5):
        alone = m.score(ids[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]))
        assert alone[0] == pytest.approx(whole[k], rel=1e-5)
    other = ids.copy()
    other[133] = (other[133] + 1) % 50
    z, total, _ = m.forward(m.inputs(ids, off)[at], on)
    z2, total2, _ = m.forward(m.inputs(other, off)[at], on)
    assert np.allclose(z / total[:, None], z2 / total2[:, None]) and z.shape == (134, m.classes)
    p = sum(10 ** m.score(np.array([i]), np.array([0, 1]))[0] for i in range(51))
    assert p == pytest.approx(1, rel=1e-4)


def test_learns():
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 200)
    off = np.array([0, len(ids)])
    m = lm.Attention(20, np.bincount(ids, minlength=21))
    at, on = m.windows(ids, off)
    before = m.score(ids, off)[0]
    m.fit(m.inputs(ids, off)[at], m.klass[ids][at], on, epochs=60)
    assert m.score(ids, off)[0] > 0.3 * before


def test_all_training_documents_teach(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 3)
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, k=60))) for i in range(120)]
    teach = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    # One document's words in another order: no count changes, only what the windows hold.
    fits = []
    for swap in [None, *r.sample(teach, 4)]:
        df = spark.createDataFrame([(i, " ".join(sorted(t.split())) if i == swap else t) for i, t in rows], "doc_id long, text string")
        fits.append(lm.fit(df, PATH, P.PATTERN))
    bpe = lm.load(PATH, P.PATTERN)
    c = np.zeros(len(bpe.ranks) + 1)
    for i, t in rows:
        if i in teach:
            for x in bpe.encode_pieces([b" " + w.encode() for w in t.split()]):
                np.add.at(c, x, 1)
            c[-1] += 1
    want = lm.Attention(len(bpe.ranks), c)
    assert all(np.array_equal(m.klass, want.klass) and np.array_equal(m.input, want.input) and np.allclose(m.within, want.within) for m in fits)
    assert all(any(not np.array_equal(fits[0].p[k], m.p[k]) for k in m.p) for m in fits[1:])


def test_context_and_classes():
    m = lm.Attention(5000, 1 / np.arange(1, 5002))
    assert m.classes > 96
    at, on = m.windows(np.zeros(500, int), np.array([0, 500]))
    assert (on[1:].argmax(1) >= 4).all()


def test_exp_of_scores_out_of_range():
    z = np.array([[-200.0, -201.0], [300.0, 299.0], [0.0, 1.0]], np.float32)
    want = np.exp(z.astype(float) - z.max(1, keepdims=True))
    lm._exp(z)
    assert np.allclose(z / z.sum(1, keepdims=True), want / want.sum(1, keepdims=True))


def test_products_in_parts():
    r = np.random.default_rng(4)
    for n in (0, 5, 256, 700):
        a, b = r.normal(size=(n, 3)), r.normal(size=(n, 4))
        assert np.allclose(lm._outer(a, b), a.T @ b)


def test_scores_out_of_range_with_biases():
    m = lm.Attention(300)
    r = np.random.default_rng(6)
    m.p["out"] *= 200
    m.p["bias"] = r.normal(size=m.classes).astype(np.float32)
    x, on = r.integers(0, 300, (3, lm.WINDOW)), np.ones((3, lm.WINDOW), bool)
    z, total, kept = m.forward(x, on)
    assert np.isfinite(z).all() and np.isfinite(total).all() and (total > 0).all()
    p = z * np.exp(m.p["bias"]) / total[:, None]
    assert np.allclose(p.sum(1), 1, rtol=1e-4)
    want = kept[-2].astype(float) @ m.p["out"] + m.p["bias"]
    want = np.exp(want - want.max(1, keepdims=True))
    assert np.allclose(p, want / want.sum(1, keepdims=True), atol=1e-4)


def test_step_in_parts():
    m = lm.Attention(300, np.arange(301))
    off = np.concatenate([[0], np.cumsum([3, 700, 16, 40, 1])])
    ids = np.random.default_rng(7).integers(0, 301, off[-1])
    at, on = m.windows(ids, off)
    assert len(at) > lm.SOME
    x, y = m.inputs(ids, off)[at], m.klass[ids][at]
    value, g = m.loss(x, y, on)
    alone = [(on[k].sum() / on.sum(), *m.loss(x[k : k + 1], y[k : k + 1], on[k : k + 1])) for k in range(len(x))]
    assert value == pytest.approx(sum(n * a for n, a, _ in alone), rel=1e-5)
    for k in g:
        assert np.allclose(g[k], sum(n * b[k] for n, _, b in alone), atol=1e-6)


def test_a_group_keeps_its_texts_as_numbers_of_words():
    rows = corpus()
    batch = lm.pa.RecordBatch.from_pydict({"doc_id": lm.pa.array([i for i, _ in rows], lm.pa.int64()), "text": [t for _, t in rows], "learn": [i is not None and i % 2 == 0 for i, _ in rows]})
    slabs = list(lm.util.pieces(iter([batch.slice(0, 90), batch.slice(90)])))
    u, c, size, raw, docs = lm._distinct(slabs)
    words = [x.tobytes() for x in np.split(raw, np.cumsum(size)[:-1])]
    got, taught = [], Counter()
    for part in docs:
        name, known, learn, n, index = lm._unpack(part, "<i8", "u1", "u1", "<i4", "<i4")
        for i, k, teaches, some in zip(name.tolist(), known, learn, np.split(index, np.cumsum(n)[:-1]), strict=True):
            texts = [words[w].decode() for w in some]
            got.append((i if k else None, texts))
            taught.update(texts * int(teaches))
    assert got == [(i, tokens(t)[:-1]) for i, t in rows]
    assert (np.diff(u.astype(object)) > 0).all() and [taught[w.decode()] for w in words] == c.tolist()
