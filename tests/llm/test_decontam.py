import random

import numpy as np

from ragloom.llm import decontam


def distance(item, text):
    """Fewest edits that make all of item some part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def world(seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdeé  ") for _ in range(n)).strip() or "x"
    items = [(i, line(r.randrange(20, 90))) for i in range(12)] + [(50, "short"), (51, None), (None, line(40))]
    docs = []
    for i in range(80):
        text = line(r.randrange(0, 200))
        if i % 2:
            t = list(items[r.randrange(12)][1])
            for _ in range(r.randrange(0, 9)):
                k = r.randrange(len(t))
                t[k : k + r.randrange(2)] = r.choice(["", "x", "éa", t[k].upper()])
                t = t or ["x"]
            text += " " + "".join(t).replace(" ", r.choice([" ", "\n", "  "])) + " " + line(r.randrange(0, 100))
        docs.append((i, text))
    return items, docs + [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1])]


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        items, docs = world(seed)
        d = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, edits int")
        b = spark.createDataFrame(items, "item_id long, text string")
        want = []
        for i, t in docs:
            for k, item in items:
                n = decontam.normalise(item)
                if k is not None and len(n) >= decontam.Q:
                    e = distance(n, decontam.normalise(t))
                    if e <= decontam.edits(len(n)):
                        want.append((i, k, e))
        got = decontam.leaks(d, b).collect()
        assert sorted(((x.doc_id, x.item_id, x.edits) for x in got), key=str) == sorted(want, key=str)
        text = {i: decontam.normalise(t) for i, t in docs}
        names = {k: decontam.normalise(t) for k, t in items if k is not None}
        for x in got:
            assert distance(names[x.item_id], text[x.doc_id][x.start : x.end]) == x.edits
        kept = decontam.clean(d, b)
        assert kept.columns == d.columns
        bad = {i for i, *_ in want}
        assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_blocks_and_no_rows(spark, monkeypatch):
    items, docs = world(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(d, b).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert sorted(map(tuple, decontam.leaks(d, b).collect()), key=str) == whole and decontam.clean(d, b).count() < d.count()
    assert decontam.leaks(d.limit(0), b).collect() == [] and decontam.leaks(d, b.limit(0)).collect() == []
    assert decontam.clean(d, b.limit(0)).count() == len(docs)


def test_align():
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    assert decontam.align(code("abcd"), code("xxabcdxx"), -8, 8) == (0, 2, 6)
    assert decontam.align(code("abcd"), code("xxabdxx"), -8, 8)[0] == 1
    assert decontam.align(code("abcd"), code(""), -8, 8)[0] == 4


def test_short_items(spark):
    r = random.Random(6)
    items = [(k, "".join(r.choice("abé ") for _ in range(r.randrange(1, 8)))) for k in range(60)] + [(70, " "), (71, "ab"), (72, "AB"), (73, "a long item of many characters"), (None, "b")]
    docs = [(i, "".join(r.choice("abcé \n") for _ in range(r.randrange(0, 40)))) for i in range(60)] + [(90, None), (91, "ab"), (92, "zzz"), (93, "so a long item of many characters")]
    plain = [(k, decontam.normalise(t)) for k, t in items if k is not None and decontam.normalise(t)]
    want = {(i, k, decontam.normalise(t).find(x)) for i, t in docs for k, x in plain if x in decontam.normalise(t)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(d, b).collect()
    assert {(x.doc_id, x.item_id, x.start) for x in got} == want and len(got) == len(want)
    assert {x.doc_id for x in decontam.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, *_ in want}
