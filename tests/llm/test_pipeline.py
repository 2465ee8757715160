import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from ragloom.llm import decontam, pii

from .test_bpe import RANKS
from .test_neardup import brute

EN = "the quick brown fox jumps over the lazy dog and then other things happen in the field near old river".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann geschieht etwas anderes auf dem feld".split()


def documents():
    rows = []
    for i in range(60):
        w = (EN if i % 2 else DE) * 3
        w = [f"{x}{(i * 31 + k * 7) % 97}q" if k % 4 == i % 4 else x for k, x in enumerate(w)]
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "src", 0))
    rows += [(100 + i, rows[i][1] + " extra", rows[i][2], "src", 0) for i in range(5)]
    rows += [(200, rows[7][1] + " An Item of the benchmark that nobody may see in training. " + "word " * 9, "en", "src", 0)]
    rows += [(300, rows[9][1].replace("fox", "mail me@home.example.com or +1 (442) 555-2960 fox"), "en", "src", 0)]
    rows += [(400, "12345 !!", None, None, None), (401, None, "en", None, None), (402, "", "en", "x", 0), (None, "a text without an id but letters", "en", "x", 3), (5, rows[5][1], "en", "src", 0)]
    return [(i, t, lang, s, None if n is None else len(t or "")) for i, t, lang, s, n in rows]


def test_stages_against_plain_versions(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "an item of the benchmark, that nobody may see in training"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cols, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "byte_bpe" or docs.columns == cols
        seen[name] = docs.collect()
    ids = lambda name: sorted((r.doc_id for r in seen[name]), key=str)
    assert ids("language_id") == sorted((r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)
    kept = [(r.doc_id, r.text) for r in seen["language_id"] if r.doc_id is not None]
    want = sorted({i for i, _, c in brute(kept, 5) if i == c})
    assert [i for i in ids("near_duplicates") if i is not None] == sorted(want, key=str) and len(want) < len(kept)
    assert set(ids("near_duplicates")) - set(ids("decontamination")) == {200}
    by = {r.doc_id: r for r in seen["personal_data"]}
    before = {r.doc_id: r for r in seen["decontamination"]}
    for i, r in by.items():
        base = pii.base_spans(before[i].text)
        assert r.text == before[i].text if not base and r.n_chars == before[i].n_chars else all(before[i].text[a:b] not in r.text for _, a, b in base)
    assert "[EMAIL]" in by[300].text and "[PHONE]" in by[300].text and by[300].n_chars == len(by[300].text)
    enc = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    last = {r.doc_id: r for r in seen["byte_bpe"]}
    for i, r in by.items():
        assert last[i].n_tokens == len(enc.encode_ordinary(r.text)) and last[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert whole == sorted(map(tuple, seen["byte_bpe"]), key=str)
    assert decontam.normalise(items[0][1]) not in " ".join(decontam.normalise(r.text) for r in by.values())


def test_clashing_columns_repeated_ids_and_no_rows(spark, tmp_path):
    text = " ".join(EN)
    rows = [(1, text + " one two three", "en", "s", 7, "a", 0.5, "x", "y", 1), (1, text + " another ending here", "en", "s", 8, "b", 0.25, None, "z", 2)]
    rows += [(2, text.upper() + " four five six seven", "en", "t", 9, None, None, "q", "r", 3), (3, None, "en", "u", None, "c", 0.1, "p", "o", 4), (4, "12 +", "de", "u", 4, "c", 0.1, "p", "o", 5)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "text searched", "text before", "rep"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, `text searched` string, `text before` string, rep int")
    spark.createDataFrame([(1, "nothing that occurs here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, df.schema).repartition(3)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.util.materialise(stage(spark, docs, str(tmp_path)), "stage")
            assert docs.columns == names
        # Of the rows of document 1 the one with the least text stays; 2 is its near copy or stays, 3 and 4 have no letter.
        got = sorted(map(tuple, docs.collect()))
        assert got[0] == rows[1] and {r[0] for r in got} <= {1, 2} and all(r in rows for r in got)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == len(got)
    none = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []


def test_letters_beyond_the_second_plane_and_set_checkpoint_folder(spark, tmp_path):
    from ragloom.llm import langid, util

    assert langid.letters()[0x32000] == 1 == langid.letters()[ord("a")]
    assert util.fresh("score", ["Score", "score_"]) == "score__"
    was = spark.sparkContext.getCheckpointDir()
    if was is None and spark.conf.get("spark.checkpoint.dir", None) is None:
        assert util.shared_dir(spark).startswith("file:///")
