import zlib

from ragloom.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the other things happen"
DE = "der schnelle braune fuchs springt über den faulen hund und dann geschieht das andere"
FR = "le renard brun rapide saute par dessus le chien paresseux et puis les autres choses"


def rows():
    out = []
    for i in range(90):
        lang, text = [("en", EN), ("de", DE), ("fr", FR)][i % 3]
        w = text.split()
        out.append((i, " ".join(w[i % 5 :] + w[: i % 7]), lang, "s", 1.0))
    return out


def test_predictions(spark):
    extra = [(1000, None, "en", "s", 1.0), (1001, "123 !!", "de", "s", 1.0), (1002, "Fuchses Hunden geschiehts", None, None, None), (1003, "foxes thingy jumping", None, "s", 2.0), (1004, "日本", "xx" if False else None, "s", 1.0), (1005, "  ", "fr", "s", 1.0), (None, "the dog", "en", "s", 1.0)]
    df = spark.createDataFrame(rows() + extra + extra[2:3], "doc_id long, text string, lang string, source string, score double")
    model = langid.fit(df)
    assert model.langs == ["de", "en", "fr"]
    out = langid.predict(df, model)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "lang_pred", "score"}
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, lang, *_ in rows():
        assert got[i][0].lang_pred == lang and got[i][0].text == text
    assert [got[i][0].lang_pred for i in (1000, 1001, 1005, None)] == ["und", "und", "und", "en"]
    assert got[1000][0].text is None and got[1000][0].score == 0
    assert [r.lang_pred for r in got[1002]] == ["de", "de"] and got[1003][0].lang_pred == "en" and got[1004][0].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for x in got.values() for r in x)


def test_held_out_rows_teach_nothing(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, score double")
    lied = df.rdd.map(lambda r: (r[0], r[1], "zz" if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[2], r[3], r[4])).toDF(df.schema)
    assert langid.fit(lied).langs == ["de", "en", "fr"]
    assert {r.held for r in df.select(langid.held_out().alias("held")).collect()} == {True, False}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    r = langid.predict(df, langid.fit(df)).collect()
    assert [(x.lang_pred, x.score) for x in r] == [("und", 0.0)]
    none = df.limit(0)
    assert langid.predict(none, langid.fit(none)).collect() == []
