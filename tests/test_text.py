import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ragloom.functions import guards as G
from ragloom.functions import text as T
from ragloom.operators import chunking, context, noise, selection
from ragloom.plans import queries
from ragloom.sources import files, web


def test_loops_as_the_pattern_has_it():
    slow = re.compile(r"(.{20,}?)\1{3,}", re.S)
    r = random.Random(1)
    for _ in range(400):
        block = "".join(r.choice("ab") for _ in range(r.randrange(1, 30)))
        text = "".join(r.choice("abc") for _ in range(r.randrange(30))) + block * r.randrange(1, 9) + "".join(r.choice("abc") for _ in range(r.randrange(30)))
        assert T.loops(text) == bool(slow.search(text)), text
    assert not T.loops("") and T.loops("a" * 80) and not T.loops("a" * 79) and T.loops("x" * 200_000)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("The policy grants twenty days of leave and the rest is", True),
        ("The policy grants twenty days of leave and no more.", False),
        ("The values are as follows for everyone here\n- Trust\n- Hope", False),
        ("The values are as follows for everyone here and now\n- Trust and", True),
        ("short", False), ("", False), (None, False),
    ],
)
def test_cut_off(spark, text, cut):
    assert one(spark, text, G.is_cut_off) is cut


def test_guards(spark):
    long = "Okay, let me think about this. Hmm, the user asks for the leave policy and " + "x" * 80
    rows = [(long, True), ("I think the leave policy allows ten days. Wait, no.", False), ("The policy names three kinds of leave. " * 3, False), (None, False)]
    for text, leak in rows:
        assert (one(spark, text, lambda c: F.size(G.leak_markers(c))) > 0) is leak
    loop = "The leave policy grants each member twenty days of leave every year. "
    assert one(spark, loop * 4, G.is_degenerate) and not one(spark, loop, G.is_degenerate)
    assert one(spark, "you are a m0r0n", G.is_foul) and one(spark, "this is shiiiit", G.is_foul) and not one(spark, "hello there", G.is_foul)
    assert one(spark, "Hi there!", G.is_casual) and not one(spark, "Hi, what is the leave policy?", G.is_casual) and one(spark, "thanks a lot", G.is_casual)
    assert one(spark, "x\nAnswer: yes.", G.clean_answer) == "yes."


def test_stems_and_parts(spark):
    words = {"policies": "policy", "days": "days", "types": "type", "class": "class", "status": "status", "training": "train", "retired": "retir", "probation": "probat", "salary": "salary", "voluntary": "volunt", "its": "its"}
    for w, s in words.items():
        assert one(spark, w, T.stem) == s, w
    assert one(spark, "What is the annual leave policy and how do I apply for sick leave?", T.question_parts) == ["What is the annual leave policy", "how do I apply for sick leave"]


def test_noise_and_chunks():
    text = "Contents\n1.1 Leave .... 3\n1.2 Pay .... 9\n# Body\n" + "Acme Running Title\nA sentence of the body that stays.\nPage 3 of 9\n" * 3
    got, toc, chrome = noise.strip(text)
    assert toc == 3 and chrome == 6 and got.count("that stays") == 3 and "Page" not in got and "Acme" not in got
    doc = "4.1 Annual Leave\n" + "ALPHA is about annual leave in every way. " * 40 + "\n4.2 Sick Leave\n" + "BETA is about sick leave in every way. " * 40
    chunks = chunking.split(doc)
    assert len(chunks) > 3 and all("4.1" in c.section for c in chunks if "ALPHA" in c.text) and all("4.2" in c.section for c in chunks if "BETA" in c.text)
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} | {'x' * 30} |" for i in range(60))
    parts = chunking.split(table, chunking.Sizes(table=500))
    assert all(c.kind == "table" and c.text.startswith("| a | b |\n| --- |") and len(c.text) <= 520 for c in parts)
    assert {f"row {i}" for i in range(60)} <= {f"row {m}" for c in parts for m in re.findall(r"row (\d+)", c.text)}
    assert noise.repair_tables("| a | b |\n2 Director 5,000\n\nplain prose that goes on for a good while here") == "| a | b |\n| 2 Director 5,000 |\n\nplain prose that goes on for a good while here"


def test_selection_keeps_its_bounds():
    r = random.Random(2)
    for n in (19, 20, 21, 150):
        rows = [{"chunk_id": i, "file_name": f"f{i % 4}", "chunk_index": i, "section_header": f"s{i % 6}", "text": r.choice(["annual leave", "sick", "pay"]) + " x", "is_toc": i % 9 == 0, "score": r.random()} for i in range(n)]
        got = selection.Selection(rows, 20, "annual leave and sick pay", ["annual leave", "sick pay"], False).run()
        ids = [x["chunk_id"] for x in got]
        assert len(ids) == len(set(ids)) <= 20
        if n > 20:
            assert not any(x["is_toc"] for x in got) and len(got) == min(20, sum(not x["is_toc"] for x in rows))


def test_context_and_sheets():
    assert context.fit([("A sentence. Another one that is long", False, ""), ("| t |" * 40, True, "")], 130) == "A sentence. Another one that is long"
    assert len(context.fit([("word " * 4000, False, "S")])) <= context.BUDGET
    md = files.sheet_markdown([(0, 0, "Name"), (0, 1, "A|B"), (2, 0, "x\ny"), (3, 1, "5")], "f.xlsx", "S")
    assert md.startswith("## f.xlsx — S") and "2 rows x 2 columns" in md and "A\\|B" in md and "| x y |  |" in md
    assert files.sheet_markdown([(0, 0, "Name")], "f", "s") is None and files.sheet_markdown([], "f", "s") is None
    assert web.text_of("<html><head><title>t</title><style>p{}</style></head><body><p>One &amp; two<br>three</p><script>x</script></body>") == "One & two\nthree"


def test_chunk_queries_see_documents(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["leave", "pay", "sick", "days"], k=300)) + ".\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "en", f"s{i % 2}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x", 0, "y")], "n_nationkey long, n_name string, n_regionkey long, n_comment string").write.parquet(f"{tmp_path}/nation.parquet")
    chunks = {(x.doc_id, x.chunk_id) for x in queries.chunk_docs(spark, str(tmp_path)).collect()}
    assert len(chunks) > 20 and {(x.doc_id, x.chunk_id) for x in queries.embed_chunks(spark, str(tmp_path)).collect()} == chunks
    assert {x.doc_id for x in queries.chunk_tables(spark, str(tmp_path)).collect() if x.content_type == "table"} == {-1, *range(20)}
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} for t in (re.sub(r"\s+", " ", x[1].lower()) for x in rows)]
    got = {(x.a, x.b): x.similarity for x in queries.trigram_jaccard_docs(spark, str(tmp_path)).collect()}
    assert got == {(a, b): pytest.approx(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), abs=1e-5) for a in range(20) for b in range(a + 2, 20, 2) if a // 16 == b // 16}


def test_trigram_pairs_of_long_texts(spark, tmp_path):
    r = random.Random(6)
    letters = "abcdefgh \n\tÉß\U0001f600"
    rows = [(7 * i, "".join(r.choices(letters, k=40_000 if i % 3 == 0 else r.randrange(60))), f"s{i % 4 // 3}") for i in range(60)]
    rows += [(-5, None, "s0"), (-6, "ab", "s1"), (None, "abc", "s0"), (None, "abc", "s1"), (1, "abcabc", None), (2, "abcabc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {(x.a, x.b): x.similarity for x in queries.trigram_jaccard_docs(spark, str(tmp_path)).collect()}
    assert time.time() - began < 15
    gram = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    want = {}
    for s in ("s0", "s1"):
        mine = sorted(((i, gram(re.sub(r"\s+", " ", (t or "").lower()))) for i, t, x in rows if x == s), key=lambda x: (x[0] is not None, x[0]))
        for k in range(0, len(mine), 8):
            block = [x for x in mine[k : k + 8] if x[0] is not None]
            want |= {(a, b): len(g & h) / max(1, len(g | h)) for n, (a, g) in enumerate(block) for b, h in block[n + 1 :]}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    # A source's order is the same when no task meets the whole of it.
    split = selection.numbered(df, "source", "doc_id", "text", each=5)
    order = {(x.source, x.doc_id, x.n) for x in split.collect() if x.source}
    assert order == {(s, i, n) for s in ("s0", "s1") for n, i in enumerate(sorted((i for i, _, x in rows if x == s), key=lambda i: (i is not None, i)))}


def test_page_clean_strips_each_page(spark):
    own = "Contents\n1.1 Leave .... 3\n# Body\n" + "Acme Running Title\nBody line.\n" * 3 + "Page 2 of 3\n \n\t\n\nend"
    pages = [(i, f"Shared site navigation\n{own}\nonly on {i}") for i in range(3)] + [(9, "Shared site navigation")]
    df = spark.createDataFrame(pages, "page_id long, text string")
    shared = spark.createDataFrame([("shared site navigation",)], "line string")
    got = {r.page_id: r.text for r in noise.page_clean(df, shared).collect()}
    plain = lambda t: re.sub(r"(?m)^[ \t]*\n(?:[ \t]*\n){2,}", "\n\n", noise.strip("\n".join(x for x in t.split("\n") if noise.normalise(x) != "shared site navigation"))[0]).strip()
    assert got == {i: plain(t) for i, t in pages}
    assert "Page 2" not in got[0] and "Contents" not in got[0] and "Acme" not in got[0] and got[0].count("Body line.") == 3 and got[9] == ""


def test_sub_points_and_page_lines():
    doc = "4.2 Annual Leave\nIntro of the section.\n4.2.1 Who may\nALPHA of the first point.\nSee overleaf, © 2024 Acme, for more.\n4.2.2. How\nBETA of the second point.\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n4.3 Sick Leave\nGAMMA after it."
    got = chunking.split(doc)
    assert [(c.kind, c.section) for c in got] == [("text", "4.2 Annual Leave"), ("text", "4.2 Annual Leave / 4.2.1"), ("text", "4.2 Annual Leave / 4.2.2"), ("table", "4.2 Annual Leave / 4.2.2"), ("text", "4.3 Sick Leave")]
    assert got[1].text == "[4.2 Annual Leave / 4.2.1]\n4.2.1 Who may\nALPHA of the first point." and "BETA" in got[2].text and "GAMMA" in got[4].text
    assert chunking.split("1.2.3 x\nsome words")[0].section == "1.2.3"


def test_page_gate_keeps_raw_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 300, "x" * 300), (2, "y" * 250, "y" * 250), (3, "z" * 199, "z" * 199), (4, "", "w" * 200)], "page_id long, text string, raw_text string")
    shared = spark.createDataFrame([("a shared line",)], "line string")
    got = {r.page_id: (r.status, r.text) for r in noise.page_gate(df, shared).collect()}
    assert got == {1: ("ok", "x" * 300), 2: ("kept_raw", "y" * 250), 3: ("failed", None), 4: ("kept_raw", "w" * 200)}
    assert {r.status for r in noise.page_gate(df, shared.limit(0)).where("page_id > 1").collect()} == {"failed"}
    html = [(i, f"u{i}", f"<body><p>Shared site navigation</p><p>{c * n}</p></body>") for i, c, n in ((1, "a", 400), (2, "b", 230), (3, "c", 20))]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.status for r in queries.page_gate_pages(spark, str(tmp_path)).collect()} == {1: "ok", 2: "kept_raw", 3: "failed"}


def test_casual_reads_whole_turns(spark, tmp_path):
    rows = [(1, 1, "user", "thanks a lot " + "x " * 500_000 + "what is the leave policy"), (2, 1, "user", "thanks a lot")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id: r.casual for r in queries.guard_casual(spark, str(tmp_path)).collect()} == {1: False, 2: True}


def test_repair_tables_after_blank_lines():
    table = "| a | b |\n"
    same = lambda rest: noise.repair_tables(table + rest) == table + rest
    assert noise.repair_tables(table + "\nTk.500 for each day of the month and more\nend of the table is here, in a long line") == table + "\n| Tk.500 for each day of the month and more |\nend of the table is here, in a long line"
    for after in ("paid in BDT by the fund to each member", "12 Annual leave for the members of staff", "Short piece", "rates 1,200 and more of them in a long line"):
        assert noise.repair_tables(table + "\n" + after) == table + f"\n| {after} |"
    assert same("\nA sentence of its own.\nx") and same("\nThen:\nx")
    assert noise.repair_tables(table + "Annual Leave of all the members of staff") == table + "| Annual Leave of all the members of staff |"
    assert same("Annual leave of all the members of staff") and noise.repair_tables("no table\n5 x") == "no table\n5 x"


def test_error_classes(spark):
    kinds = {"HTTP 429 Too Many Requests": "quota", "503 Service Unavailable": "unavailable", "bad key": "other", "RESOURCE_EXHAUSTED": "quota", None: "other"}
    for message, kind in kinds.items():
        assert one(spark, message, G.error_class) == kind


def test_trigram_pairs_are_all_of_a_source(spark, tmp_path):
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghij \n\tÉß\U0001f600"[: r.choice([3, 6, 16])], k=r.randrange(300))) for _ in range(70)]
    rows = [(r.randrange(400) * 3 - 50, r.choice(texts), f"s{i % 5 // 4}") for i in range(90)]
    rows += [(-60, None, "s0"), (-61, "ab", "s0"), (-62, "abcabc", "s2"), (None, "abc", "s0"), (1, "abcabc", None), (2, "abcabc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sets = [(i, {t[k : k + 3] for t in [re.sub(r"\s+", " ", (x or "").lower())] for k in range(len(t) - 2)}, s) for i, x, s in rows if i is not None and s]
    want = sorted((a, b, round(len(g & h) / max(1, len(g | h)), 5)) for a, g, s in sets for b, h, t in sets if a < b and s == t)
    same = lambda out: sorted((x.a, x.b, round(x.similarity, 5)) for x in out.collect()) == [pytest.approx(w, abs=2e-5) for w in want]
    assert len(want) > 2000 and same(queries.trigram_jaccard_docs(spark, str(tmp_path)))
    # Many blocks and tiles give the same.
    assert same(selection.trigram_pairs(df, block=20, tile=7)) and same(selection.trigram_pairs(df, chars=2000, tile=1))


def test_shared_trigrams_by_either_way():
    r = random.Random(9)
    codes = [T.trigram_codes("".join(r.choices("abcdefg"[: r.choice([2, 7])], k=r.randrange(200)))) for _ in range(60)]
    a, b = T.trigram_table(codes[:25]), T.trigram_table(codes[25:])
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in codes[25:]] for x in codes[:25]]
    for share, columns, most in ((0.005, 4096, 1 << 22), (0, 7, 1), (2, 7, 1), (2, 7, 500), (0.1, 50, 100)):
        assert T.shared_trigrams(a, b, share, columns, most).tolist() == want
