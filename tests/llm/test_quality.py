import random

import numpy as np
import pytest

from ragloom.llm import quality


def test_expectation_maximisation_finds_accuracies():
    r = random.Random(1)
    right = [0.95, 0.8, 0.65, 0.6]
    counts = {}
    for _ in range(20000):
        good = r.random() < 0.7
        p = "".join("0" if r.random() < 0.2 else ("+" if good else "-") if r.random() < a else ("-" if good else "+") for a in right)
        counts[p] = counts.get(p, 0) + 1
    m = quality.expectation_maximisation(counts, rounds=300)
    assert m.prior == pytest.approx(0.7, abs=0.05)
    assert m.accuracy() == pytest.approx(right, abs=0.06)
    assert m.posterior("++00") > 0.95 and m.posterior("--00") < 0.1 and m.posterior("0000") == pytest.approx(m.prior)


def rows():
    r = random.Random(2)
    vocab = ["w" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    out, labels = [], []
    for i in range(400):
        w = [r.choice(vocab) for _ in range(60)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            w[5:5] = ["idiot", "scum"] if i % 2 else ["zorrga" + r.choice("abc")]
        out.append((i, " ".join(w), "x"))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return out, labels


def test_scores(spark):
    docs, labels = rows()
    extra = [(900, None, "x"), (901, "", None), (902, "?!", "x"), (None, docs[1][1], "x"), (1, docs[1][1], "x"), (903, docs[5][1] * 500, "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, keep string").repartition(3)
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5000, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = quality.score(d, quality.fit(d, lab)).collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= x.quality_prob <= 1 and 0 <= x.toxic_prob <= 1 for x in out)
    keep = {x.doc_id: x.keep for x in out}
    wrong = [i for i in range(400) if i % 3 == 0 and keep[i] != (i % 5 != 0 and i % 7 != 0)]
    assert len(wrong) <= 13  # a tenth of the rows that have no label
    assert [keep[i] for i in (900, 901, 902)] == [False] * 3 and keep[None] == keep[1] is True
    none = d.limit(0)
    assert quality.score(none, quality.fit(none, lab.limit(0))).collect() == []
    assert quality.score(d, quality.fit(d, lab.limit(0))).count() == len(docs) + len(extra)


def test_features_of_texts_do_not_depend_on_the_slab():
    import pyarrow as pa

    texts = ["One two, two!", "", "A line\nA line\nA line\nB", "ééé x"]
    slab = lambda t: pa.RecordBatch.from_pydict({"text": pa.array(t, pa.large_string())})
    whole = quality.Texts(slab(texts))
    for i, t in enumerate(texts):
        one = quality.Texts(slab([t]))
        assert np.array_equal(one.features()[0], whole.features()[i])
        assert all(one.stats[s][0] == whole.stats[s][i] for s in quality.STATS)


def test_scores_against_plain_sums_and_telling_features():
    import pyarrow as pa

    r = np.random.default_rng(3)
    texts = ["One two, two!", "", "A line\nA line\nA line\nB", "ééé x one"]
    x = quality.Texts(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())}))
    scorers = [quality.Scorer(), quality.Scorer()]
    for s in scorers:
        s.w, s.b = np.where(r.random(1 << quality.BITS) < 0.5, r.normal(size=1 << quality.BITS), 0).astype(np.float32), 0.3
    for s, got in zip(scorers, x.scores(*scorers), strict=True):
        assert got == pytest.approx([1 / (1 + np.exp(-(sum(float(s.w[k]) for k in f) + s.b))) for f in x.features()], abs=1e-6)
    y = np.array([1.0] * 90 + [0.0] * 10)
    # In ten bad texts and nowhere else; in as many good as chance has it; too rare; in none.
    assert quality.telling(np.array([10, 50, 3, 0]), np.array([0, 45, 0, 0.0]), y).tolist() == [True, False, False, False]
    assert not quality.telling(np.array([10]), np.array([10.0]), np.ones(20)).any() and not quality.telling(np.array([0]), np.array([0.0]), np.zeros(0)).any()


def test_nobody_votes_on_toxicity(spark):
    docs, labels = rows()
    clean = [d for d in docs if not {"idiot", "scum"} & set(d[1].split())]
    d = spark.createDataFrame(clean, "doc_id long, text string, keep string")
    out = quality.score(d, quality.fit(d, spark.createDataFrame([(i, q, None) for i, q, _ in labels], "doc_id long, quality int, toxic int"))).collect()
    assert all(x.toxic_prob < 0.5 for x in out) and sum(x.keep for x in out) > len(out) / 2
