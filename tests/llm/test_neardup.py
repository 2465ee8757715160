import random
import re

import numpy as np

from ragloom.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def own_set(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num=80, den=100):
    sets = [own_set(t, k) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and sets[i] and sets[j] and (a == b or den * both >= num * (len(sets[i]) + len(sets[j]) - both)):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((a, len(s), None if a is None else find(a) if s else a) for (a, _), s in zip(rows, sets, strict=True)) if all(a is not None for a, _ in rows) else None


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)] + ["Élan", "ß", "The", "the"]
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.6:
            w = list(r.choice(texts))
            for _ in range(r.randrange(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 10, 40, 120]))]
        texts.append(w)
        rows.append((i * 3 + 1, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100000, None), (100001, ""), (100002, " \n"), (100003, " "), (100004, "ONE"), (100005, "one")]
    r.shuffle(rows)
    return rows


def got(spark, rows, k):
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k).collect()
    assert all(x.kept == (x.doc_id == x.component_id) for x in out if x.doc_id is not None)
    return sorted((x.doc_id, x.n_shingles, x.component_id) for x in out)


def test_against_brute_force(spark):
    for seed, k in ((1, 2), (2, 5)):
        rows = corpus(seed)
        assert got(spark, rows, k) == brute(rows, k)


def test_chain_and_large_group(spark):
    base = ["x%d" % i for i in range(101)]
    chain = [(i, " ".join(["y%d" % j for j in range(2 * i)] + base[2 * i :])) for i in range(20)]
    rows = chain + [(1000 + i, " ".join(base[:90] + ["z%d" % (i * 7 + j) for j in range(9)])) for i in range(300)]
    assert got(spark, rows, 2) == brute(rows, 2)


def test_repeated_null_and_no_rows(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (2, "a b c d e f"), (9, "p q r s t u"), (9, "p q r s t u")]
    assert got(spark, rows, 2) == [(2, 5, 2), (5, 5, 2), (5, 5, 2), (9, 5, 2), (9, 5, 2)]
    df = spark.createDataFrame([(None, "a b c d e f", "s"), (2, "a b c d e f", "t"), (None, None, None)], "doc_id long, text string, regs string")
    out = sorted(map(tuple, neardup.near_duplicates(df, 2).collect()), key=str)
    assert out == sorted([(None, 5, None, True), (2, 5, 2, True), (None, 0, None, True)], key=str)
    assert neardup.near_duplicates(df.limit(0), 2).collect() == []


def test_sketch():
    r = np.random.default_rng(5)
    for n, both in ((1000, 800), (300, 0), (50, 40), (3, 3)):
        x = r.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = x[:n], x[n - both :]
        s = neardup.sketch([a, b, np.union1d(a, b)], 2048)
        assert (neardup.merge(s[0], s[1]) == s[2]).all()
        j = both / len(x)
        assert abs((s[0] == s[1]).mean() - j) < 0.05
        assert abs(neardup.estimate(s[:1], s[1:2], np.array([n * 1.0]), np.array([n * 1.0]))[0] - j) < 0.05


def test_reaches_is_the_estimate():
    r = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        x = r.integers(0, 2**63, 600).astype(np.uint64)
        sets += [x[:300], x[int(r.integers(0, 280)) :][:300]]
    s, n = neardup.sketch(sets), np.full(40, 300.0)
    for least in (0.4, 0.6):
        want = neardup.estimate(s[::2], s[1::2], n, n) >= least - 1e-9
        assert (neardup.reaches(s[::2], s[1::2], n, n, least) == want).all() and 0 < want.sum() < 40


def test_shared_sizes_and_spanning_links():
    r = np.random.default_rng(9)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(20)] + [np.array([999], np.uint64)]
    left, right = np.arange(0, 12), np.arange(5, 21)
    want = [[len(np.intersect1d(sets[i], sets[j])) if i != j else None for j in right] for i in left]
    got = neardup.shared_sizes(sets, left, right, columns=7)
    assert all(w is None or w == g for a, b in zip(want, got.tolist()) for w, g in zip(a, b))
    assert neardup._spanning(np.array([5, 5, 9, 7]), np.array([0, 1, 0, 2]), np.array([2, 2, 3, 3])) == [0, 2]


def test_long_text_and_many_unlinked_members(spark):
    r = random.Random(4)
    word = lambda: "w%d" % r.randrange(40000)
    long = [word() for _ in range(60000)]
    base = [word() for _ in range(100)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:55000] + [word() for _ in range(3000)])), (3, " ".join(long[:40000]))]
    # Members share their base's bands, but few of them are links: blocks on both sides.
    rows += [(100 + i, " ".join(x if r.random() < 0.94 else word() for x in base)) for i in range(600)]
    r.shuffle(rows)
    assert got(spark, rows, 2) == brute(rows, 2)
