from ragloom.operators import context


def test_injected_models(spark):
    df = spark.createDataFrame([(1, "q", "a text"), (2, "q", None)], "query_id long, question string, text string")
    e = {r.query_id: r for r in context.embed(df, context.hashing_embedder).collect()}
    assert len(e[1].embedding) == 64 and abs(sum(x * x for x in e[1].embedding) - 1) < 1e-5
    s = {r.query_id: r.rerank_score for r in context.score_pairs(df, lambda q, t: [float(len(x)) for x in t]).collect()}
    assert s == {1: 6.0, 2: 0.0}

    def fails(p):
        raise RuntimeError("429 quota exceeded")

    p = df.selectExpr("query_id", "question AS prompt")
    assert [r.error for r in context.generate(p, fails).collect()] == ["429 quota exceeded"] * 2
    assert [r.answer for r in context.generate(p, str.upper).collect()] == ["Q", "Q"]
