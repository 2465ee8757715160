"""One query for each operator, over whole tables, and the SQL that gives the same rows.

Documents stand in for chunks (file_name: source, chunk_id: doc_id, section_header:
lang), benchmark items for questions, conversations for sessions and answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import text as T
from ..operators import admin, chunking, context, noise, retrieval, selection, versions
from ..session import table
from ..sources import files, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), T.lexical_keywords(F.col("text")).alias("keywords"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.contains(F.col("text"), F.lit("|")), "table").otherwise("text")
    return table(s, d, "documents").select("doc_id", F.col("source").alias("file_name"), F.col("lang").alias("section_header"), kind.alias("content_type"), "text")


def _list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


# Keywords of the questions in SQL: kw(query_id, pos, keyword), at most 12 for each.
_STOP = ", ".join(f"'{w}'" for w in T.LEXICAL_STOP + T.LEXICAL_EXCLUDED)
_KW = rf"""
toks AS (SELECT item_id AS query_id, string_split_regex(regexp_replace(lower(text), '[^a-z0-9.\s-]', ' ', 'g'), '\s+') AS a FROM benchmark),
tok AS (SELECT query_id, unnest(a) AS keyword, generate_subscripts(a, 1) AS i FROM toks),
kw0 AS (SELECT query_id, keyword, min(i) AS i FROM tok
  WHERE (length(keyword) >= 3 OR regexp_full_match(keyword, '\d+(\.\d+)+')) AND length(keyword) <= 40 AND keyword NOT IN ({_STOP}) GROUP BY ALL),
kw AS (SELECT * FROM (SELECT query_id, keyword, row_number() OVER (PARTITION BY query_id ORDER BY i) AS pos FROM kw0) WHERE pos <= 12)
"""
_HITS = """
hits AS (SELECT query_id, doc_id, count(*) AS hits FROM kw JOIN documents ON contains(lower(text), keyword) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM hits) WHERE rank <= 100)
"""
_STEM = """
CASE WHEN length(w) <= 4 THEN w
     WHEN ends_with(w, 'ies') AND length(w) > 5 THEN substr(w, 1, length(w) - 3) || 'y'
     WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND NOT ends_with(w, 'us') THEN substr(w, 1, length(w) - 1)
     WHEN ends_with(w, 'ing') AND length(w) > 7 THEN substr(w, 1, length(w) - 3)
     WHEN ends_with(w, 'ed') AND length(w) > 6 THEN substr(w, 1, length(w) - 2)
     WHEN ends_with(w, 'ion') AND length(w) > 7 THEN substr(w, 1, length(w) - 3)
     WHEN ends_with(w, 'ary') AND length(w) > 6 THEN substr(w, 1, length(w) - 3) ELSE w END
"""
_POST = f"""
words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents),
post AS (SELECT {_STEM} AS term, doc_id, count(*) AS tf FROM words WHERE length(w) >= 3 GROUP BY ALL),
terms AS (SELECT DISTINCT query_id, {_STEM.replace("(w", "(keyword").replace(" w", " keyword")} AS term FROM kw),
rank0 AS (SELECT query_id, doc_id, CAST(sum(tf) AS BIGINT) AS score FROM post JOIN terms USING (term) GROUP BY ALL),
bytf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rank0) WHERE rank <= 100)
"""
_RRF = """
rrf AS (SELECT query_id, doc_id, coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS score,
  least(coalesce(b.rank, 1000), coalesce(l.rank, 1000)) AS best_rank, b.rank IS NOT NULL AS in_vector
  FROM bytf b FULL JOIN lex l USING (query_id, doc_id))
"""
_COS = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
"""


# ---- questions and text ----


@query(f"WITH {_KW} SELECT query_id, pos, keyword FROM kw")
def lex_keywords(s, d):
    q = _questions(s, d)
    return q.select("query_id", F.posexplode("keywords").alias("pos", "keyword")).select("query_id", (F.col("pos") + 1).cast("long").alias("pos"), "keyword")


_SEL = ", ".join(f"'{w}'" for w in T.SELECTION_STOP)


@query(rf"""
WITH toks AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s-]', '', 'g'), '\s+'), lambda w: length(w) >= 3 AND w NOT IN ({_SEL})) AS a FROM benchmark),
one AS (SELECT item_id, a, unnest(a) AS k, generate_subscripts(a, 1) AS i FROM toks)
SELECT DISTINCT item_id AS query_id, k AS keyword FROM one
UNION SELECT item_id, k || ' ' || a[i + 1] FROM one WHERE i < len(a)
""")
def q_keywords(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.selection_keywords(F.col("text"))).alias("keyword"))


@query(r"SELECT item_id AS query_id, regexp_matches(lower(text), '\b(types?|kinds?|lists?|all|various|each)\b') AS is_list, length(text) AS n FROM benchmark")
def q_features(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), T.is_list_question(F.col("text")).alias("is_list"), F.length("text").cast("long").alias("n"))


@query()
def q_parts(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(T.question_parts(F.regexp_replace("text", r"\. ", "? "))).alias("part", "text"))


@query(f"WITH words AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) SELECT w AS word, {_STEM} AS stem FROM words WHERE w <> ''")
def stem_light(s, d):
    w = table(s, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", T.stem(F.col("word")).alias("stem"))


@query(r"""
WITH t AS (SELECT a.item_id AS a, b.item_id AS b, lower(regexp_replace(a.text, '\s+', ' ', 'g')) AS x, lower(regexp_replace(b.text, '\s+', ' ', 'g')) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
g AS (SELECT a, b, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS ga, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3))) AS gb FROM t)
SELECT a, b, round(len(list_intersect(ga, gb))::DOUBLE / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS similarity FROM g
""")
def trigram_jaccard(s, d):
    t = table(s, d, "benchmark").select("item_id", T.trigrams(F.col("text")).alias("g"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("g").alias("ga")), t.select(F.col("item_id").alias("b"), F.col("g").alias("gb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.jaccard(F.col("ga"), F.col("gb")), 6).alias("similarity"))


@query()
def trigram_jaccard_docs(s, d):
    return selection.trigram_pairs(table(s, d, "documents"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
_TRIM = r"regexp_replace(regexp_replace({}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"


@query(rf"""
WITH l AS ({_LINES}), t AS (SELECT doc_id, pos, {_TRIM.format("raw")} AS t FROM l)
SELECT doc_id, pos, length(t) > 0 AND length(t) <= 220 AND regexp_matches(t, '[0-9]\s*$') AND (regexp_matches(t, '\.{{2,}}\s*[0-9]+\s*$') OR regexp_matches(t, '-{{2,}}\s*[0-9]+\s*$')
  OR (length(t) < 180 AND length(t) > 20 AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '\s{{2,}}[0-9]+\s*$'))) AS is_toc,
  length(t) <= 120 AND (regexp_matches(t, '^(?i)(chapter|section|part|annex|appendix)\s+[0-9]+') OR regexp_matches(t, '^[0-9]+(\.[0-9]+)*\s+[A-Z]')) AS is_title FROM t
""")
def toc_lines(s, d):
    t = table(s, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "raw")).withColumn("t", T.trim(F.col("raw")))
    return t.select("doc_id", F.col("pos").cast("long").alias("pos"), T.is_toc_line(F.col("t")).alias("is_toc"), T.is_toc_title(F.col("t")).alias("is_title"))


@query()
def toc_chunk(s, d):
    return table(s, d, "documents").select("doc_id", T.is_toc_chunk(F.col("text")).alias("is_toc"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS a FROM documents)
SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS sentence FROM p""")
def sentence_split(s, d):
    t = table(s, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return t.withColumn("pos", F.col("pos").cast("long"))


@query(r"""
WITH h AS (SELECT doc_id, text, regexp_extract(text, '(?m)^#{1,4}\s+(.*)$', 1) AS md, regexp_extract(text, '(?m)^([0-9]{1,2}\.[0-9]{1,2}\.?\s+[A-Za-z].{0,110})$', 1) AS no FROM documents),
s AS (SELECT doc_id, text, trim(CASE WHEN md <> '' THEN md ELSE no END) AS section_header FROM h)
SELECT doc_id, section_header, length(CASE WHEN section_header = '' OR starts_with(text, '[' || section_header || ']') THEN text ELSE '[' || section_header || ']' || chr(10) || text END) AS labelled_length FROM s
""")
def section_header(s, d):
    t = table(s, d, "documents").select("doc_id", "text", T.section_header(F.col("text")).alias("section_header"))
    return t.select("doc_id", "section_header", F.length(T.with_section_prefix(F.col("text"), F.col("section_header"))).cast("long").alias("labelled_length"))


# ---- retrieval ----


def _vectors(s, d, k: int = 100, least: float = 0.0):
    e = table(s, d, "embeddings")
    return retrieval.vector_topk(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, least)


@query(f"WITH {_COS}, r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2) SELECT * FROM r WHERE rank <= 100")
def vector_topk(s, d):
    return _vectors(s, d, 100, 0.2)


@query(f"WITH {_COS}, n AS (SELECT *, count(*) FILTER (WHERE score >= 0.5) OVER (PARTITION BY query_id) AS hits FROM s WHERE score >= 0.4) SELECT query_id, vec_id, score, hits < 5 AS retried FROM n WHERE score >= CASE WHEN hits < 5 THEN 0.4 ELSE 0.5 END")
def vector_fallback(s, d):
    return retrieval.vector_fallback(_vectors(s, d, 10**9, 0.4)).drop("rank")


@query(f"WITH {_KW}, {_HITS} SELECT query_id, doc_id, hits, rank FROM lex")
def lex_ilike(s, d):
    return retrieval.keyword_hits(table(s, d, "documents"), _questions(s, d))


@query(f"WITH {_KW}, {_POST} SELECT query_id, doc_id, score, rank FROM bytf")
def lex_rank(s, d):
    q = _questions(s, d)
    return retrieval.keyword_rank(retrieval.postings(table(s, d, "documents"), terms=retrieval.query_terms(q)), q)


@query(f"WITH {_KW}, {_HITS} SELECT query_id, doc_id, round(greatest(0.40, 0.99 - 0.01 * (rank - 1)), 6)::DOUBLE AS score FROM lex")
def lex_pseudo(s, d):
    return lex_ilike(s, d).select("query_id", "doc_id", F.round(retrieval.pseudo_score(F.col("rank")).cast("double"), 6).alias("score"))


def _fused(s, d):
    return retrieval.fuse(lex_rank(s, d), lex_ilike(s, d), "doc_id")


@query(f"WITH {_KW}, {_HITS}, {_POST}, {_RRF} SELECT query_id, doc_id, round(score, 9) AS score, best_rank, in_vector FROM rrf")
def rrf_fuse(s, d):
    return _fused(s, d).withColumn("score", F.round("score", 9))


@query(rf"""WITH {_KW}, {_HITS}, {_POST}, {_RRF} SELECT query_id, doc_id, round(score + CASE WHEN regexp_matches(lower(b.text), '\b(types?|kinds?|lists?|all|various|each|the)\b') AND contains(d.text, '|') THEN 0.08 ELSE 0 END, 9) AS score
FROM rrf JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id""")
def rrf_table_boost(s, d):
    q = _questions(s, d).select("query_id", "question")
    f = _fused(s, d).join(_chunks(s, d).select("doc_id", "content_type"), "doc_id").join(F.broadcast(q), "query_id")
    is_list = T.is_list_question(F.col("question")) | F.lower("question").rlike(r"\bthe\b")
    return retrieval.boost_tables(f, is_list, F.col("content_type") == "table").select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH {_COS}, exact AS (SELECT query_id, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY ALL),
place AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, c) / sqrt(list_dot_product(c, c)) DESC, label) AS place FROM q, c)
SELECT {", ".join(f"round(avg((place <= {p})::INT), 4) AS recall_{p}" for p in (1, 2, 5, 10))} FROM exact JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) JOIN place USING (query_id, label)""")
def ann_recall(s, d):
    """Share of exact neighbours that a search confined to the nearest labels' clusters finds, for several numbers of clusters."""
    e = table(s, d, "embeddings").withColumn("v", F.transform("embedding", lambda c: c.cast("double")))
    exact = _vectors(s, d, 10, -1.0).select("query_id", "vec_id")
    dims = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("c"))  # a row for each cluster
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v").join(F.broadcast(centre), F.lit(True))
    order = Window.partitionBy("query_id").orderBy(F.desc(dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("c"), F.col("c")))), "label")
    probed = q.select("query_id", "label", F.row_number().over(order).alias("place"))
    found = exact.join(e.select("vec_id", "label"), "vec_id").join(probed, ["query_id", "label"])
    return found.groupBy().agg(*[F.round(F.avg((F.col("place") <= p).cast("double")), 4).alias(f"recall_{p}") for p in (1, 2, 5, 10)])


# ---- selection ----


def _candidates(s, d):
    """Fused candidates with all that selection reads."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), T.question_parts(F.col("text")).alias("parts"), T.is_list_question(F.col("text")).alias("is_list"))
    c = _chunks(s, d).select(F.col("doc_id").alias("chunk_id"), "file_name", F.col("doc_id").alias("chunk_index"), "section_header", "content_type", "text", T.is_toc_chunk(F.col("text")).alias("is_toc"))
    f = _fused(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return f.select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank").join(c, "chunk_id").join(F.broadcast(q), "query_id")


@query()
def dedup_greedy(s, d):
    c = _candidates(s, d).select("query_id", "file_name", "rank", "chunk_id", "text")
    return selection.drop_near_copies(c).select("query_id", "file_name", "rank", "chunk_id")


@query()
def select_diverse(s, d):
    return selection.select_diverse(_candidates(s, d))


_CAND = f"""{_KW}, {_HITS}, {_POST}, {_RRF},
cand AS (SELECT query_id, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, source AS file_name, lang AS section_header, text FROM rrf JOIN documents USING (doc_id))
"""


@query(f"WITH {_CAND}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id, section_header ORDER BY rank) AS in_section FROM cand) SELECT query_id, chunk_id, rank, in_section FROM w WHERE in_section <= 5")
def section_cap(s, d):
    return selection.section_cap(_candidates(s, d)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "in_section")


@query(f"""WITH {_CAND}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, section_header ORDER BY score DESC, chunk_id) AS n, max(score) OVER (PARTITION BY query_id, section_header) AS m FROM cand)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n, m DESC, section_header, chunk_id) AS position FROM a""")
def round_robin(s, d):
    return selection.round_robin(_candidates(s, d), "section_header").select("query_id", "chunk_id", "position")


@query(f"""WITH {_CAND}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_name ORDER BY chunk_id) - 1 AS i, count(*) OVER (PARTITION BY query_id, file_name) AS t FROM cand),
z AS (SELECT *, least(2, i // greatest(1, t // 3)) AS zone FROM a), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_name, zone ORDER BY score DESC, chunk_id) AS place_in_zone FROM z)
SELECT query_id, chunk_id, CAST(zone AS BIGINT) AS zone, place_in_zone, t <= 5 OR place_in_zone <= CASE zone WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 3 END AS picked FROM p""")
def zone_pick(s, d):
    return selection.zone_pick(_candidates(s, d), 5).select("query_id", "chunk_id", "zone", "place_in_zone", "picked")


@query(f"""WITH {_CAND}, f AS (SELECT query_id, file_name, avg(score) AS a, bool_or(rank <= 20) AS has_hit FROM cand GROUP BY ALL),
l AS (SELECT query_id, list_sort(list(a)) AS means FROM f GROUP BY ALL)
SELECT query_id, file_name, round(a, 8) AS avg_score, has_hit, row_number() OVER (PARTITION BY query_id ORDER BY has_hit DESC, round(a, 8) DESC, file_name) AS file_rank FROM f""")
def file_rank(s, d):
    c = _candidates(s, d).withColumn("has_hit", F.col("rank") <= 20)
    f = selection.file_rank(c).withColumn("avg_score", F.round("avg_score", 8))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("has_hit"), F.desc("avg_score"), "file_name")).cast("long")
    return f.select("query_id", "file_name", "avg_score", "has_hit", place.alias("file_rank"))


@query(f"""WITH {_CAND}, n AS (SELECT query_id, count(*) AS n FROM cand GROUP BY ALL),
hit AS (SELECT query_id, chunk_id, keyword FROM cand JOIN kw USING (query_id) WHERE contains(lower(text), keyword)),
c AS (SELECT query_id, keyword, count(*) AS chunks FROM hit GROUP BY ALL)
SELECT query_id, keyword, chunks, chunks <= greatest(10, n // 10) AS rare FROM c JOIN n USING (query_id)""")
def kw_rarity(s, d):
    c = _candidates(s, d).select("query_id", "chunk_id", "text")
    k = _questions(s, d).select("query_id", F.explode("keywords").alias("keyword"))
    n = c.groupBy("query_id").agg(F.count("*").alias("n"))
    hit = c.join(F.broadcast(k), "query_id").where(F.contains(F.lower("text"), F.col("keyword"))).groupBy("query_id", "keyword").agg(F.count("*").alias("chunks"))
    return hit.join(n, "query_id").select("query_id", "keyword", "chunks", (F.col("chunks") <= F.greatest(F.lit(10), F.floor(F.col("n") / 10))).alias("rare"))


@query(f"""WITH {_CAND}, h AS (SELECT query_id, chunk_id, count(*) AS n FROM cand JOIN kw USING (query_id) WHERE contains(lower(text), keyword) GROUP BY ALL),
p AS (SELECT DISTINCT query_id, chunk_id FROM cand JOIN (SELECT a.query_id, a.keyword || ' ' || b.keyword AS pair FROM kw a JOIN kw b ON a.query_id = b.query_id AND b.pos = a.pos + 1) USING (query_id) WHERE contains(lower(text), pair))
SELECT query_id, chunk_id, CASE WHEN p.chunk_id IS NOT NULL THEN 'phrase' WHEN h.chunk_id IS NOT NULL THEN 'keyword' ELSE 'remaining' END AS class
FROM cand LEFT JOIN h USING (query_id, chunk_id) LEFT JOIN p USING (query_id, chunk_id)""")
def kw_class(s, d):
    k = _questions(s, d).select("query_id", "keywords")
    c = _candidates(s, d).join(F.broadcast(k), "query_id")
    low = F.lower("text")
    pairs = F.zip_with(F.slice("keywords", 1, F.greatest(F.size("keywords") - 1, F.lit(0))), F.slice("keywords", 2, F.size("keywords")), lambda a, b: F.concat_ws(" ", a, b))
    found = F.when(F.exists(pairs, lambda p: F.contains(low, p)), "phrase").when(F.exists("keywords", lambda w: F.contains(low, w)), "keyword").otherwise("remaining")
    return c.select("query_id", "chunk_id", found.alias("class"))


# ---- context and answers ----


@query()
def ctx_budget(s, d):
    c = _candidates(s, d)
    picked = selection.select_diverse(c).select("query_id", "chunk_id").join(c, ["query_id", "chunk_id"])
    return context.build_context(picked)


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, 'file' || label AS file_name, max(score) AS score, min(rank) AS first_rank FROM r WHERE rank <= 20 GROUP BY ALL")
def sources(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("file"), F.col("label").cast("string")).alias("file_name"))
    return context.sources(_vectors(s, d, 20, -1.0).join(e, "vec_id"))


@query(f"WITH {_COS}, m AS (SELECT query_id, max(score) AS best FROM s WHERE query_id <> vec_id GROUP BY ALL) SELECT query_id, CASE WHEN best > 0 THEN floor(greatest(0.0, least(1.0, (best - 0.5) / 0.5)) * 100 + 0.5) / 100 END::DOUBLE AS confidence FROM m")
def confidence(s, d):
    m = _vectors(s, d, 10, -1.0).where("query_id <> vec_id").groupBy("query_id").agg(F.max("score").alias("best"))
    return m.select("query_id", context.confidence(F.col("best")).cast("double").alias("confidence"))


@query(f"""WITH {_KW}, {_HITS}, r AS (SELECT query_id, lex.doc_id, rank, CASE WHEN rank <= 50 THEN coalesce(quality, -1)::DOUBLE ELSE -2 END AS s FROM lex LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY ALL) l USING (doc_id))
SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS new_rank FROM r""")
def rerank_order(s, d):
    injected = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("given"))
    return context.rerank(lex_ilike(s, d).join(injected, "doc_id", "left"), "given").select("query_id", "doc_id", "rank", "new_rank")


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxicity' ELSE 'accepted' END AS verdict FROM labels")
def ground_cascade(s, d):
    return table(s, d, "labels").select("doc_id", context.ground([("quality", F.col("quality") != 0), ("toxicity", F.col("toxic") != 1)]).alias("verdict"))


_FOUL = "regexp_replace(translate(lower(text), '013457@$+', 'oieastast'), '[^a-z0-9 ]', ' ', 'g')"
for _c in " abcdefghijklmnopqrstuvwxyz0123456789":
    _FOUL = f"regexp_replace({_FOUL}, '{_c}{{3,}}', '{_c}', 'g')"


@query(rf"SELECT conv_id, turn, regexp_matches({_FOUL}, '\b({'|'.join(w.replace(' ', chr(92) + 's+') for w in G.FOUL)})\b') AS foul FROM conversations WHERE role = 'user'")
def guard_foul(s, d):
    return table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", G.is_foul(F.col("text")).alias("foul"))


@query(rf"""WITH t AS (SELECT conv_id, turn, {_TRIM.format("lower(text)")} AS t FROM conversations WHERE role = 'user'),
r AS (SELECT *, {_TRIM.format(f"regexp_replace(t, '{G.GREETING}', '')")} AS rest, contains(t, '?') AS asks, length(t) AS n FROM t)
SELECT conv_id, turn, len(list_filter({_list(G.WORK)}, lambda w: contains(t, w))) = 0 AND NOT (asks AND n > 30) AND (
  (n < 40 AND NOT asks AND regexp_matches(t, '{G.GREETING}') AND (rest = '' OR len(string_split_regex(rest, '\s+')) <= 3))
  OR regexp_matches(t, 'how\s+(are|''re|is)\s+(you|everyone|the\s+team|things)') OR regexp_matches(t, '(how''?s|how is)\s+(it\s+going|your\s+day|the\s+day)')
  OR (n < 30 AND regexp_matches(t, 'weather|rain|sunny|temperature')) OR regexp_matches(t, 'office\s+(atmosphere|busy|quiet|vibe)')
  OR regexp_matches(t, '^(thanks|thank you|appreciate it|goodbye|bye)') OR regexp_matches(t, '(what''?s?|tell me) your (name|purpose|role|capabilities)')
  OR regexp_matches(t, '(what can you|how can you) help') OR contains(t, 'who are you')) AS casual FROM r""")
def guard_casual(s, d):
    return table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", G.is_casual(F.col("text")).alias("casual"))


def _before():
    return Window.partitionBy("conv_id").orderBy("turn", "role", "text")


@query("""SELECT conv_id, turn, role, coalesce(string_agg(role || ': ' || text, chr(10)) OVER w, '') AS memory FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def conv_memory(s, d):
    t = table(s, d, "conversations")
    said = F.collect_list(F.concat(F.col("role"), F.lit(": "), F.col("text"))).over(_before().rowsBetween(-4, -1))
    return t.select("conv_id", "turn", "role", F.concat_ws("\n", said).alias("memory"))


_F_STOP = ", ".join(f"'{w}'" for w in G.FOLLOW_STOP)


# A fold in SQL: step i looks at the i-th telling word.
@query(rf"""WITH RECURSIVE l AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS last_user FROM conversations),
t AS (SELECT conv_id, turn, text, {_TRIM.format("text")} AS q, string_split_regex(regexp_replace(lower(last_user), '[^a-z0-9\s-]', ' ', 'g'), '\s+') AS toks FROM l WHERE role = 'user'),
g AS (SELECT row_number() OVER () AS id, *, length(q) <= 80 AND (regexp_matches(lower(q), '{G.FOLLOW_UP[0]}') OR regexp_matches(lower(q), '{G.FOLLOW_UP[1]}') OR (NOT contains(lower(q), '?') AND len(string_split_regex(q, '\s+')) <= 6)) AS follows,
  coalesce(list_filter(toks, lambda w: length(w) >= 4 AND w NOT IN ({_F_STOP}) AND NOT contains(lower(q), w)), []) AS good FROM t),
f(id, good, carry) AS (SELECT id, good, '' FROM g UNION ALL
  SELECT id, good[2:], CASE WHEN contains(carry, good[1]) OR len(string_split(carry, ' ')) >= 5 THEN carry WHEN carry = '' THEN good[1] ELSE carry || ' ' || good[1] END FROM f WHERE len(good) > 0),
d AS (SELECT id, carry FROM f WHERE len(good) = 0)
SELECT conv_id, turn, CASE WHEN follows AND carry <> '' THEN q || ' ' || carry ELSE text END AS question FROM g JOIN d USING (id)""")
def followup_rewrite(s, d):
    t = table(s, d, "conversations").withColumn("last_user", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(_before().rowsBetween(-4, -1)))
    return t.where("role = 'user'").select("conv_id", "turn", G.follow_up(F.col("text"), F.col("last_user")).alias("question"))


_A = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"


@query(rf"""WITH a AS ({_A}), t AS (SELECT conv_id, turn, {_TRIM.format("text")} AS t FROM a),
l AS (SELECT conv_id, turn, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM t)
SELECT conv_id, turn, length(t) >= 40 AND NOT contains('.!?"''’”)]}}:;', right(t, 1))
  AND NOT (len(ls) >= 2 AND regexp_matches(ls[-1], '^([-*+•–—] |(?i)([0-9]+|[a-z])[.)]\s+\S)') AND regexp_matches(ls[-2], '^([-*+•–—] |(?i)([0-9]+|[a-z])[.)]\s+\S)')) AS cut_off FROM l""")
def ans_cutoff(s, d):
    return _answers(s, d).select("conv_id", "turn", G.is_cut_off(F.col("text")).alias("cut_off"))


@query(f"""WITH a AS ({_A}), m AS (SELECT conv_id, turn, text, len(list_filter({_list(G.LEAK_STRONG)}, lambda m: contains(lower(text), m))) AS strong, len(list_filter({_list(G.LEAK_SOFT)}, lambda m: contains(lower(text), m))) AS soft FROM a)
SELECT conv_id, turn, length(text) >= 80 AND (strong > 0 OR soft >= 3 OR (soft >= 2 AND length(text) > 1500)) AS leak FROM m""")
def ans_leak(s, d):
    return _answers(s, d).select("conv_id", "turn", (F.size(G.leak_markers(F.col("text"))) > 0).alias("leak"))


_MOST = "coalesce(list_max(list_transform(list_distinct({0}), lambda p: len(list_filter({0}, lambda x: x = p)))), 0)"


@query(rf"""WITH a AS ({_A}), l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: regexp_replace({_TRIM.format("x")}, '\s+', ' ', 'g')), lambda x: length(x) >= 30) AS ls,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '([.?!]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format("x")}), lambda x: len(string_split_regex(x, '\s+')) >= 8) AS ss FROM a)
SELECT conv_id, turn, {_MOST.format("ls")} >= 4 OR {_MOST.format("ss")} >= 3 AS degenerate FROM l""")
def ans_degenerate(s, d):
    return _answers(s, d).select("conv_id", "turn", G.is_degenerate(F.col("text")).alias("degenerate"))


@query(f"WITH a AS ({_A}) SELECT conv_id, turn, len(list_filter({_list(G.NO_INFO)}, lambda m: contains(lower(text), m))) > 0 AS no_info FROM a")
def ans_noinfo(s, d):
    return _answers(s, d).select("conv_id", "turn", G.is_no_info(F.col("text")).alias("no_info"))


@query(rf"""WITH a AS ({_A}), t AS (SELECT conv_id, turn, {_TRIM.format("regexp_replace('Analysis: x' || chr(10) || 'Answer: ' || coalesce(text, ''), '(?is)^.*answer:', '')")} AS t FROM a)
SELECT conv_id, turn, {_TRIM.format(r"regexp_replace(t, '(?is)^\s*(analysis|final answer)\s*:\s*', '')")} AS answer FROM t""")
def ans_clean(s, d):
    return _answers(s, d).select("conv_id", "turn", G.clean_answer(F.concat(F.lit("Analysis: x\nAnswer: "), F.col("text"))).alias("answer"))


_VALUES = [(1, "model,rules"), (2, " RULES , model, rules"), (3, "none"), (4, ""), (5, "model")]


@query("SELECT * FROM (VALUES (1::BIGINT, 'model,rules'), (2, 'rules,model'), (3, ''), (4, ''), (5, 'model')) t(id, used)")
def providers(s, d):
    return s.createDataFrame(_VALUES, "id long, config string").select("id", F.array_join(G.providers(F.col("config"), ("model", "rules")), ",").alias("used"))


# Messages: the documents, some with a status in front.
@query("""WITH m AS (SELECT doc_id, lower(CASE doc_id % 4 WHEN 1 THEN 'HTTP 429 ' WHEN 2 THEN 'status 503: ' ELSE '' END || coalesce(text, '')) AS m FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(m, '429|resource_exhausted|quota exceeded') THEN 'quota' WHEN regexp_matches(m, 'unavailable|503|rate|overloaded|too many requests') THEN 'unavailable' ELSE 'other' END AS kind FROM m""")
def err_class(s, d):
    status = F.when(F.col("doc_id") % 4 == 1, "HTTP 429 ").when(F.col("doc_id") % 4 == 2, "status 503: ").otherwise("")
    return table(s, d, "documents").select("doc_id", G.error_class(F.concat(status, F.coalesce("text", F.lit("")))).alias("kind"))


# ---- noise, pages, chunks ----


@query(rf"""WITH l AS ({_LINES}), t AS (SELECT doc_id, lower(regexp_replace({_TRIM.format("raw")}, '\s+', ' ', 'g')) AS line FROM l)
SELECT doc_id, line, count(*) AS n FROM t WHERE line <> '' AND length(line) <= 120 GROUP BY ALL HAVING count(*) >= 3""")
def line_freq(s, d):
    return noise.line_counts(table(s, d, "documents"))


@query()
def strip_noise(s, d):
    return noise.strip_noise(table(s, d, "documents")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "toc_removed", "chrome_removed")


@query()
def repair_tables(s, d):
    fix = F.pandas_udf(lambda x: x.fillna("").map(noise.repair_tables), "string")
    return table(s, d, "documents").select("doc_id", F.sha2(fix("text"), 256).alias("text_sha256"))


@query()
def html_text(s, d):
    return web.html_text(table(s, d, "pages"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(s, d):
    return table(s, d, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS domain FROM pages")
def url_domain(s, d):
    return table(s, d, "pages").select("page_id", web.domain(F.col("url")).alias("domain"))


@query(r"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -1, 'https:x.example' UNION ALL SELECT -2, 'ftp://x' UNION ALL SELECT -3, 'http:///p')
SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'bad protocol' WHEN regexp_extract(url, '(?i)^https?://([^/?#]+)', 1) = '' THEN 'no host' ELSE 'ok' END AS status,
  CASE WHEN page_id = -1 THEN 'https://x.example' END AS hint FROM u""")
def url_validate(s, d):
    more = s.createDataFrame([(-1, "https:x.example"), (-2, "ftp://x"), (-3, "http:///p")], "page_id long, url string")
    u = table(s, d, "pages").select("page_id", "url").unionByName(more)
    return u.select("page_id", web.validate(F.col("url")).alias("status"), web.repair_hint(F.col("url")).alias("hint"))


_PL = rf"""WITH l AS ({_LINES}), t AS (SELECT doc_id, pos, raw, lower(regexp_replace({_TRIM.format("raw")}, '\s+', ' ', 'g')) AS line FROM l),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), b AS (SELECT line, count(DISTINCT doc_id) AS pages FROM t, n WHERE length(line) >= 12 GROUP BY line, n HAVING n >= 2 AND count(DISTINCT doc_id) >= greatest(2, (n + 1) // 2))"""


@query(f"{_PL} SELECT line, pages FROM b")
def page_boilerplate(s, d):
    return noise.page_boilerplate(table(s, d, "documents"), page_id="doc_id")


@query()
def page_clean(s, d):
    t = web.html_text(table(s, d, "pages"))
    return noise.page_clean(t, noise.page_boilerplate(t))


@query("SELECT doc_id, CASE WHEN length(text) >= 300 THEN 'ok' ELSE 'failed' END AS status FROM documents")
def page_gate(s, d):
    return noise.page_gate(table(s, d, "documents").withColumn("raw_text", F.col("text"))).select("doc_id", "status")


@query()
def page_gate_pages(s, d):
    t = web.html_text(table(s, d, "pages"))
    shared = noise.page_boilerplate(t)
    cleaned = noise.page_clean(t, shared).join(t.withColumnRenamed("text", "raw_text"), "page_id")
    return noise.page_gate(cleaned, shared).select("page_id", "status", "text")


@query()
def chunk_docs(s, d):
    return chunking.chunk_docs(table(s, d, "documents")).select("doc_id", "chunk_id", "chunk_index", "total_chunks", "content_type", "section_header")


@query()
def chunk_tables(s, d):
    md = files.table_markdown(table(s, d, "nation"), "nation.xlsx", "nation", "n_nationkey").select(F.lit(-1).cast("long").alias("doc_id"), "text")
    docs = table(s, d, "documents").select("doc_id", "text").unionByName(md)
    return chunking.chunk_docs(docs, chunking.Sizes(table=400)).select("doc_id", "chunk_index", "content_type", "row_group", "text")


@query()
def embed_chunks(s, d):
    e = context.embed(chunking.chunk_docs(table(s, d, "documents")), context.hashing_embedder)
    return e.select("doc_id", "chunk_id", F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("norm"))


@query("""SELECT '## region.xlsx — region' || chr(10) || chr(10) || count(*) || ' rows x 2 columns: r_regionkey, r_name' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10)
  || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS text FROM region""")
def sheet_to_md(s, d):
    return files.table_markdown(table(s, d, "region"), "region.xlsx", "region", "r_regionkey")


@query("""WITH t AS (SELECT CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source || '__' ELSE source || '__' || lang || '__' END || doc_id || '.md' AS name FROM documents)
SELECT name, CASE WHEN contains(name, '__') THEN split_part(name, '__', 1) ELSE 'General' END AS file_type, CASE WHEN contains(name, '__') THEN substr(name, instr(name, '__') + 2) ELSE name END AS file_name FROM t""")
def file_type_split(s, d):
    k = F.col("doc_id") % 3
    start = F.when(k == 0, "").when(k == 1, F.concat("source", F.lit("__"))).otherwise(F.concat("source", F.lit("__"), "lang", F.lit("__")))
    t = table(s, d, "documents").select(F.concat(start, F.col("doc_id").cast("string"), F.lit(".md")).alias("name"))
    return t.select("name", files.file_type(F.col("name")).alias("file_type"), files.plain_name(F.col("name")).alias("file_name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_meta(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ---- versions ----


def _stored(s, d):
    return table(s, d, "documents").where("doc_id % 3 <> 0").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"),
        (F.col("doc_id") % 4).alias("version"))


def _incoming(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"))


_ST = """stored AS (SELECT 'f' || doc_id || '.md' AS file_name, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS file_hash, strlen(text) AS file_size, doc_id % 4 AS version FROM documents WHERE doc_id % 3 <> 0),
incoming AS (SELECT 'f' || doc_id || '.md' AS file_name, sha256(text) AS file_hash, strlen(text) AS file_size FROM documents)"""


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", versions.content_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {_ST} SELECT i.file_name, CASE WHEN s.file_name IS NULL THEN 'new' WHEN s.file_hash = i.file_hash AND s.file_size = i.file_size THEN 'unchanged' ELSE 'changed' END AS status FROM incoming i LEFT JOIN stored s USING (file_name)")
def change_status(s, d):
    return versions.change_status(_incoming(s, d), _stored(s, d)).select("file_name", "status")


@query("SELECT o_custkey AS file_name, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL")
def kb_latest(s, d):
    return versions.latest(table(s, d, "orders").select(F.col("o_custkey").alias("file_name"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price")))


@query(f"WITH {_ST} SELECT file_name FROM incoming i WHERE EXISTS (SELECT 1 FROM stored s WHERE s.file_name = i.file_name AND s.file_hash = i.file_hash)")
def kb_processed(s, d):
    return versions.processed(_incoming(s, d), _stored(s, d)).select("file_name")


@query(f"WITH {_ST} SELECT i.file_name, coalesce(max(version), 0) + 1 AS next_version FROM (SELECT DISTINCT file_name FROM incoming) i LEFT JOIN stored USING (file_name) GROUP BY ALL")
def kb_next_version(s, d):
    return versions.next_version(_incoming(s, d), _stored(s, d))


@query(f"WITH {_ST} SELECT file_name, version FROM stored WHERE regexp_replace(file_name, '\\.[^.]+$', '') NOT IN (SELECT 'f' || doc_id FROM documents WHERE doc_id % 2 = 0)")
def kb_remove(s, d):
    names = table(s, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"))
    return versions.remove(_stored(s, d), names, by_base=True).select("file_name", "version")


@query(f"""WITH {_ST}, fresh AS (SELECT file_name, file_hash, file_size, 9::BIGINT AS version FROM incoming WHERE file_size % 2 = 0)
SELECT * FROM stored WHERE file_name NOT IN (SELECT file_name FROM fresh) UNION ALL SELECT * FROM fresh""")
def kb_swap(s, d):
    return versions.swap(_stored(s, d), _incoming(s, d).where("file_size % 2 = 0").withColumn("version", F.lit(9).cast("long")))


@query(f"""WITH {_ST}, t AS (SELECT left(i.file_name, 2) AS source, CASE WHEN s.file_name IS NULL THEN 'new' WHEN s.file_hash = i.file_hash AND s.file_size = i.file_size THEN 'unchanged' ELSE 'changed' END AS status, i.file_size // 1000 AS segments FROM incoming i LEFT JOIN stored s USING (file_name))
SELECT source, count(*) FILTER (WHERE status = 'new') AS "new", count(*) FILTER (WHERE status = 'changed') AS updated, count(*) FILTER (WHERE status = 'unchanged') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(segments) AS BIGINT) AS segments FROM t GROUP BY ALL""")
def ing_summary(s, d):
    t = versions.change_status(_incoming(s, d), _stored(s, d))
    return versions.summary(t.select(F.substring("file_name", 1, 2).alias("source"), "status", F.floor(F.col("file_size") / 1000).alias("segments")))


# ---- administration ----


@query("""SELECT count(*) AS chunks, count(DISTINCT source) AS files, count(*) FILTER (WHERE coalesce(lang, '') = '') AS without_section, count(*) FILTER (WHERE contains(text, '|')) AS tables,
  round(avg(length(text)), 2) AS avg_length, max(length(text)) AS max_length, count(*) FILTER (WHERE length(text) > 2000) AS oversize FROM documents""")
def kb_stats(s, d):
    return admin.corpus_stats(_chunks(s, d))


def _settings(s):
    rows = [(1, "top_k", "20", "retrieval"), (2, "show_sources", "false", "display"), (3, "title", "A & B <c>", "general"), (4, "system", "x", "prompt"), (5, "secret", None, "internal")]
    return s.createDataFrame(rows, "id long, config_key string, config_value string, category string")


def _suggestions(s):
    return s.createDataFrame([(1, "Leave?", 20, True), (2, "Pay & more", 10, True), (3, "Old", 15, False)], "id long, label string, sort_order int, is_active boolean")


@query("SELECT * FROM (VALUES ('show_sources', 'false'), ('title', 'A & B <c>'), ('top_k', '20')) t(config_key, config_value)")
def cfg_settings(s, d):
    return _settings(s).where(F.col("category").isin(*admin.VISIBLE)).select("config_key", "config_value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'NEW'")
def cfg_upsert(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    rows = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")).unionByName(s.createDataFrame([(-1, "NEW")], "c_custkey long, c_mktsegment string"))
    return admin.upsert(c, rows, "c_custkey")


@query("SELECT * FROM (VALUES ('missing', false), ('show_sources', false), ('top_k', true)) t(config_key, is_on)")
def cfg_flag(s, d):
    keys = s.createDataFrame([("missing",), ("show_sources",), ("top_k",)], "config_key string")
    return keys.join(_settings(s), "config_key", "left").select("config_key", admin.flag(F.col("config_value")).alias("is_on"))


@query()
def cfg_xml(s, d):
    return admin.config_xml(_settings(s), _suggestions(s))


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region WHERE r_regionkey < 3 UNION ALL SELECT r_regionkey::BIGINT, 'seed' FROM region WHERE r_regionkey >= 3")
def seed_missing(s, d):
    r = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return admin.seed_missing(r.where("id < 3"), r.select("id", F.lit("seed").alias("name")), "id")


@query("SELECT * FROM (VALUES (2::BIGINT, 'Pay & more'), (1, 'Leave?')) t(id, label)")
def sugg_list(s, d):
    return _suggestions(s).where("is_active").orderBy("sort_order", "id").select("id", "label")


@query("SELECT s_suppkey AS id, lag(s_suppkey) OVER (ORDER BY s_acctbal, s_suppkey) AS previous, lead(s_suppkey) OVER (ORDER BY s_acctbal, s_suppkey) AS next FROM supplier")
def sugg_neighbor(s, d):
    return admin.neighbours(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("sort_order")))


@query("SELECT id, sort_order FROM (VALUES (1::BIGINT, 10), (2, 20), (3, 15)) t(id, sort_order)")
def sugg_swap(s, d):
    return admin.swap_order(_suggestions(s), 1, 2).select("id", "sort_order")


def _registry(s):
    return s.createDataFrame([("a", "Answer {question} from {context}.", "chat", 1), ("b", "Judge {answer}.", "judge", 2), ("c", "Rewrite.", "chat", 3)], "prompt_key string, default_content string, prompt_group string, sort_order int")


@query("SELECT * FROM (VALUES ('chat', 'a,c'), ('judge', 'b')) t(prompt_group, keys)")
def prompt_list(s, d):
    t = _registry(s).groupBy("prompt_group").agg(F.array_sort(F.collect_list(F.struct("sort_order", "prompt_key")))["prompt_key"].alias("k"))
    return t.select("prompt_group", F.array_join("k", ",").alias("keys"))


@query("SELECT * FROM (VALUES ('a', 'Mine {question}', 'stored'), ('b', 'Judge {answer}.', 'default'), ('c', 'Rewrite.', 'default')) t(prompt_key, content, origin)")
def prompt_resolve(s, d):
    rows = s.createDataFrame([("a", "Mine {question}"), ("b", "  "), ("c", "Bad old text")], "prompt_key string, content string")
    return admin.resolve_prompts(_registry(s), rows, s.createDataFrame([("c", "Bad old text")], "prompt_key string, content string"))


@query("SELECT item_id, replace('Answer {question} from {context}.', '{question}', text) AS prompt FROM benchmark")
def prompt_render(s, d):
    return table(s, d, "benchmark").select("item_id", admin.render(F.lit("Answer {question} from {context}."), {"question": F.col("text")}).alias("prompt"))
