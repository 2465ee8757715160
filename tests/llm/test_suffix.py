import hashlib
import random

import numpy as np

from ragloom.llm import suffix


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover():
    for v in (8, 16, 32, 64):
        c = suffix.difference_cover(v)
        assert {(a - b) % v for a in c.tolist() for b in c.tolist()} == set(range(v))


def test_suffix_order():
    r = random.Random(1)
    for data in [b"", b"a", b"\0\0\0", b"banana" * 30, b"a" * 500, bytes(r.randrange(2) for _ in range(700)), bytes(r.randrange(256) for _ in range(400)), b"ab" * 200 + b"\0" * 90 + b"ab" * 100]:
        for block in (1, 64, 1 << 18):
            got = np.concatenate([np.zeros(0, np.int64), *suffix.suffix_blocks(data, block=block)]).tolist()
            assert got == sorted(range(len(data)), key=lambda i: data[i:])


def test_anchors():
    r = random.Random(2)
    buf = np.frombuffer(bytes(r.choice(b"ab") for _ in range(300)), np.uint8)
    place, value = suffix.anchors(buf, 30)
    h = suffix.util.gram_hash(buf, suffix.GRAM)
    for i in range(len(buf) - 29):
        w = h[i : i + 11]
        assert place[i] == i + int(np.argmin(w)) and value[i] == w.min()


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [line(r.randrange(30, 200)) for _ in range(12)]
    rows = [(i * 2, "".join(r.choice([r.choice(shared), line(r.randrange(1, 80)), shared[0]]) for _ in range(r.randrange(1, 8)))) for i in range(60)]
    rows += [(500 + i, rows[i][1]) for i in range(0, 30, 3)] + [(600 + i, "xyz" * 100) for i in range(4)] + [(700, "a" * 400), (701, "a" * 90), (702, "a" * 49), (703, "a" * 50)]
    return rows + [(800, None), (801, ""), (802, None), (0, rows[5][1]), (0, rows[0][1]), (900, rows[7][1][3:]), (901, "é" * 60), (902, "é" * 60)]


def test_against_brute_force(spark):
    for seed, length in ((3, 50), (4, 20)):
        rows = corpus(seed)
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((tuple(x) for x in suffix.remove_repeats(df, length).collect()), key=str)
        assert got == brute(rows, length)


def test_nulls_columns_and_no_rows(spark):
    text = "The same passage, long enough to be found more than once here."
    df = spark.createDataFrame([(None, text, "a"), (3, text, "b"), (None, text, None), (4, text + "!", "c")], "doc_id long, text string, sha string")
    got = sorted((tuple(x) for x in suffix.remove_repeats(df, with_spans=True).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(text)
    assert got == sorted([(None, n, 0, 0, sha(text), [])] * 2 + [(3, n, 0, 0, sha(text), []), (4, n + 1, n, 1, sha("!"), [0, n])], key=str)
    assert suffix.remove_repeats(df.limit(0)).collect() == []


def test_long_texts_and_small_slabs(spark, monkeypatch):
    r = random.Random(6)
    line = lambda n: "".join(r.choice("abc ") for _ in range(n))
    shared = line(3000)
    rows = [(i, line(r.randrange(400)) + shared[r.randrange(1000) : r.randrange(1000, 3000)]) for i in range(30)] + [(50, "a" * 9000), (51, "a" * 9000 + "b"), (52, shared * 3), (53, None)]
    monkeypatch.setattr(suffix, "SLAB", 700)
    group = [(hashlib.sha256((t or "").encode()).digest(), (t or "").encode(), i) for i, t in rows]
    one = suffix._Group([suffix._pack(group)], 50)
    monkeypatch.setattr(suffix, "SLAB", 1 << 20)
    two = suffix._Group([suffix._pack(group)], 50)
    for g in (one, two):
        starts = suffix._ranges(g.lo, g.hi - g.lo)
        want = [a + k for a, b in zip(g.off[:-1].tolist(), g.off[1:].tolist()) for k in range(b - a - 49)]
        assert sorted(starts.tolist()) == want
    assert set(one.head.tolist()) == set(two.head.tolist())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in suffix.remove_repeats(df, 50).collect()), key=str) == brute(rows, 50)


def test_depth_keeps_equal_prefixes_together():
    r = random.Random(7)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(4000)) * 2 + b"\xff" * 60, np.uint8)
    order = np.concatenate(list(suffix.suffix_blocks(data, np.arange(7900), depth=50)))
    raw = data.tobytes()
    keys = [raw[i : i + 50] for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(7900))
    assert suffix.equal_runs(data, order, 50).tolist() == [a == b for a, b in zip(keys, keys[1:])]
