"""Queries over texts, vectors and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import embed
from quire.functions import text as T
from quire.operators import postings, retrieve
from quire.plans.catalogue import PAGES, base, plain, query, read

QUESTION = "Licensed under the Apache License for the people of this place"
CURRENT = 40


def words_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def tokens_sql(x: str) -> str:
    return f"list_filter({words_sql(x)}, lambda t: length(t) > 1)"


P = plain(PAGES)


def vectors_sql(source: str, key: str, text: str) -> str:
    """CTE body: (key, idx, value) of hash embeddings."""
    return f"""
  SELECT {key}, idx, c / sqrt(sum(CAST(c * c AS DOUBLE)) OVER (PARTITION BY {key})) AS value FROM (
    SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384 AS idx, count(*) AS c FROM (
      SELECT {key}, unnest(CASE WHEN len(ts) = 0 THEN ['_'] ELSE ts END) AS t FROM (SELECT {key}, {words_sql(text)} AS ts FROM {source}))
    GROUP BY ALL)"""


_Q = QUESTION.replace("'", "''")
HYBRID_SQL = rf"""
WITH pages AS ({P}),
q AS (SELECT '{_Q}' AS question, {tokens_sql("'" + _Q + "'")} AS qt),
pv AS ({vectors_sql("pages", "page_num", "text")}),
qv AS ({vectors_sql("(SELECT 0 AS qid, '" + _Q + "' AS question)", "qid", "question")}),
sem AS (SELECT page_num, sum(pv.value * qv.value) AS sem FROM pv JOIN qv USING (idx) GROUP BY page_num),
scored AS (
  SELECT pdf_id, pages.page_num, coalesce(sem, 0) AS sem, len(list_filter(qt, lambda t: list_contains(tt, t))) AS hits, len(list_distinct(qt)) AS nq,
    contains(lower(text), lower(trim(question))) AS phrase, len(list_filter(qt, lambda t: contains(lower(text), t))) / greatest(len(qt), 1) AS tp,
    CASE WHEN abs(pages.page_num - {CURRENT}) = 0 THEN 3.0 WHEN abs(pages.page_num - {CURRENT}) <= 2 THEN 1.5 ELSE 0 END AS prox
  FROM (SELECT *, {tokens_sql("text")} AS tt FROM pages) AS pages CROSS JOIN q LEFT JOIN sem USING (page_num)),
lexed AS (SELECT *, hits + hits / nq + CASE WHEN phrase THEN 2.5 ELSE 0 END AS lex FROM scored),
ranked AS (SELECT pdf_id, page_num, 2 * sem + lex + prox + tp AS score FROM lexed),
top AS (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY round(score, 9) DESC, page_num DESC) AS rank FROM ranked QUALIFY rank <= 8),
hit AS (SELECT *, max(score) OVER (PARTITION BY pdf_id) AS best FROM top)
"""


def _pages(spark, d):
    return base(spark, d, PAGES)


@query("hybrid_retrieval", HYBRID_SQL + "SELECT pdf_id, page_num, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM hit WHERE score > 0 OR best <= 0")
def hybrid_retrieval(spark, d):
    hits = retrieve.retrieve(_pages(spark, d), QUESTION, 8, CURRENT)
    return hits.select("pdf_id", "page_num", "rank", F.round("score", 6).alias("score"))


#: Questions asked of every document.
ASKED = (QUESTION, "the people of this place", "data and model", "licensed")
MANY_SQL = " UNION ALL ".join(
    f"SELECT {k} AS question, * FROM ({HYBRID_SQL.replace(_Q, x)} SELECT pdf_id, page_num, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM hit WHERE score > 0 OR best <= 0)"
    for k, x in enumerate(ASKED))


@query("retrieve_many", MANY_SQL)
def retrieve_many(spark, d):
    """Several questions of every document at once, over postings that are stored before."""
    pages = _pages(spark, d)
    listed = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(x).alias("question")) for k, x in enumerate(ASKED)])
    asked = pages.select("pdf_id").distinct().select("pdf_id", F.explode(listed).alias("_q")).select(
        F.struct("pdf_id", "_q.n").alias("qid"), "pdf_id", "_q.question", F.lit(CURRENT).alias("current"))
    hits = postings.retrieve_many(postings.store(postings.post(pages)), pages, asked, 8)
    return hits.select(F.col("qid.n").alias("question"), "pdf_id", "page_num", "rank", F.round("score", 6).alias("score"))


@query("page_refs_context", HYBRID_SQL + """
SELECT pdf_id, string_agg('--- Page ' || page_num || ' ---' || chr(10) || substr(text, 1, 1400), chr(10) || chr(10) ORDER BY rank) AS context,
  list(page_num ORDER BY page_num) AS page_refs, count(*) AS chunks_used
FROM hit JOIN pages USING (pdf_id, page_num) WHERE score > 0 OR best <= 0 GROUP BY pdf_id""")
def page_refs_context(spark, d):
    pages = _pages(spark, d)
    return retrieve.context(retrieve.retrieve(pages, QUESTION, 8, CURRENT), pages)


@query("tokenize_docs", f"SELECT doc_id, CAST(len(ts) AS INT) AS n, md5(array_to_string(ts, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents)")
def tokenize_docs(spark, d):
    ts = read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return ts.select("doc_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", " ").cast("binary")).alias("digest"))


STATS_SQL = r"""
SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INT) AS words,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS lines,
  len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) / greatest(length(text), 1) AS dev_ratio,
  len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1) AS asc_ratio,
  len(regexp_extract_all(text, '\p{Nd}')) / greatest(length(text), 1) AS dig_ratio
FROM documents"""


@query("text_stats", f"SELECT * REPLACE (round(dev_ratio, 6) AS dev_ratio, round(asc_ratio, 6) AS asc_ratio, round(dig_ratio, 6) AS dig_ratio) FROM ({STATS_SQL})")
def text_stats(spark, d):
    s = read(spark, d, "documents").select("doc_id", T.text_stats(F.col("text")).alias("s"))
    return s.select("doc_id", "s.chars", "s.words", "s.lines", *[F.round(f"s.{c}", 6).alias(c) for c in ("dev_ratio", "asc_ratio", "dig_ratio")])


POOR = "chars < 140 OR words < 24 OR lines < 4 OR (dig_ratio > 0.22 AND words < 40) OR (dev_ratio < 0.02 AND asc_ratio < 0.12)"
VISION_SQL = f"""
SELECT doc_id, doc_id % 3 = 0 AND ({POOR}) AS needs_vision,
  CASE WHEN 200 >= greatest(chars, 80) THEN 200 ELSE chars END AS kept_chars FROM ({STATS_SQL})"""


@query("needs_vision_flags", VISION_SQL)
def needs_vision_flags(spark, d):
    """Direct text is missing for every third document; the vision text is a fixed one of 200 characters."""
    docs = read(spark, d, "documents")
    direct = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.repeat(F.lit("x"), 40))
    stats = docs.select("doc_id", "text", T.text_stats(direct).alias("a"), T.text_stats(F.col("text")).alias("b"))
    kept = T.accept_vision(F.col("text"), F.repeat(F.lit("v"), 200))
    return stats.select("doc_id", T.needs_vision(F.col("a"), F.col("b")).alias("needs_vision"), F.length(kept).alias("kept_chars"))


@query("extraction_method_counts", f"""
SELECT source AS pdf_id, count(*) AS pages, CAST(count_if(NOT vision AND doc_id % 3 = 0) AS BIGINT) AS ocr, CAST(count_if(vision) AS BIGINT) AS vision, CAST(count_if(doc_id % 3 <> 0) AS BIGINT) AS digital
FROM (SELECT doc_id, needs_vision AS vision FROM ({VISION_SQL})) JOIN documents USING (doc_id) GROUP BY source""")
def extraction_method_counts(spark, d):
    flags = needs_vision_flags(spark, d).withColumnRenamed("needs_vision", "v")
    docs = read(spark, d, "documents").select("doc_id", "source").join(flags, "doc_id")
    scanned = F.col("doc_id") % 3 == 0
    return docs.groupBy(F.col("source").alias("pdf_id")).agg(
        F.count("*").alias("pages"), F.count_if(~F.col("v") & scanned).alias("ocr"), F.count_if("v").alias("vision"), F.count_if(~scanned).alias("digital"))


@query("html_text_cascade", r"""
SELECT page_id, length(t) AS chars, CASE WHEN length(trim(t)) > 40 THEN 'digital' ELSE 'ocr' END AS method, md5(t) AS digest
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM pages)""")
def html_text_cascade(spark, d):
    t = read(spark, d, "pages").select("page_id", T.collapse_blank_lines(F.regexp_replace("html", "<[^>]*>", "")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.when(F.length(F.trim("t")) > 40, "digital").otherwise("ocr").alias("method"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("hash_embedding", f"SELECT doc_id, idx, round(value, 6) AS value FROM ({vectors_sql('documents', 'doc_id', 'text')})")
def hash_embedding(spark, d):
    v = embed.embed_sparse(read(spark, d, "documents"), "doc_id", "text")
    return v.select("doc_id", "idx", F.round("value", 6).alias("value"))


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("vector_topk", f"""
SELECT q, vec_id, CAST(rank AS INT) AS rank, round(sim, 6) AS sim FROM (
  SELECT a.vec_id AS q, b.vec_id, {_DOT} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id DESC) AS rank
  FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 8""")
def vector_topk(spark, d):
    """The eight nearest vectors of the same label for a stated set of query vectors."""
    from pyspark.sql import Window as W

    e = read(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"), "label")
    sims = asked.join(e, "label").where("q != vec_id").select("q", "vec_id", embed.dot(F.col("a"), F.col("embedding")).alias("s"))
    w = W.partitionBy("q").orderBy(F.desc("s"), F.desc("vec_id"))
    return sims.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("q", "vec_id", "rank", F.round("s", 6).alias("sim"))


@query("seed_similarity_max", f"""
SELECT a.vec_id, round(greatest(0, max({_DOT})), 6) AS sim FROM embeddings AS a, embeddings AS b WHERE b.vec_id IN (0, 1, 2, 3) GROUP BY a.vec_id""")
def seed_similarity_max(spark, d):
    e = read(spark, d, "embeddings")
    seeds = e.where("vec_id IN (0, 1, 2, 3)").select(F.col("embedding").alias("s"))
    sims = e.join(F.broadcast(seeds)).select("vec_id", embed.dot(F.col("embedding"), F.col("s")).alias("x"))  # four rows
    return sims.groupBy("vec_id").agg(F.round(F.greatest(F.lit(0.0), F.max("x")), 6).alias("sim"))


ITEMS = "SELECT CAST(item_id AS INT) AS ord, text AS title, CAST(item_id * 7 % 60 + 1 AS INT) AS page_from FROM {benchmark}"
PAIRS_SQL = f"""
items AS ({plain(ITEMS)}), pages AS ({P}),
asked AS (SELECT ord, t, count(*) AS times FROM (SELECT ord, unnest({tokens_sql('title')}) AS t FROM items) GROUP BY ALL),
said AS (SELECT DISTINCT pdf_id, page_num, t FROM (SELECT pdf_id, page_num, unnest({tokens_sql('text')}) AS t FROM pages)),
hit_counts AS (SELECT pdf_id, page_num, ord, sum(times) AS hits FROM said JOIN asked USING (t) GROUP BY ALL),
pairs AS (
  SELECT pages.pdf_id, items.ord, title, page_from, pages.page_num, coalesce(hits, 0) AS hits, len(list_distinct({tokens_sql('title')})) AS nq, contains(lower(text), lower(trim(title))) AS phrase
  FROM pages CROSS JOIN items LEFT JOIN hit_counts ON hit_counts.pdf_id = pages.pdf_id AND hit_counts.page_num = pages.page_num AND hit_counts.ord = items.ord),
lexed AS (SELECT pdf_id, ord, title, page_from, page_num, CASE WHEN nq = 0 THEN 0 ELSE hits + hits / nq + CASE WHEN phrase THEN 2.5 ELSE 0 END END AS lex FROM pairs)"""


@query("lexical_overlap", f"WITH {PAIRS_SQL} SELECT ord, page_num, round(lex, 6) AS lex FROM lexed WHERE lex > 0")
def lexical_overlap(spark, d):
    """Every benchmark text against every page."""
    pairs = retrieve.lexical_pairs(_pages(spark, d), base(spark, d, ITEMS))
    return pairs.select("ord", "page_num", F.round("lex", 6).alias("lex"))


@query("verify_items", f"""
WITH {PAIRS_SQL},
iv AS ({vectors_sql("items", "ord", "title")}), pv AS ({vectors_sql("pages", "page_num", "text")}),
sem AS (SELECT ord, page_num, sum(iv.value * pv.value) AS sem FROM iv JOIN pv USING (idx) GROUP BY ord, page_num),
hits AS (
  SELECT pdf_id, ord, page_from, page_num, score, row_number() OVER (PARTITION BY pdf_id, ord ORDER BY round(score, 9) DESC, page_num DESC) AS rank
  FROM (SELECT lexed.*, coalesce(sem, 0) * 2 + lex * 1.5 AS score FROM lexed LEFT JOIN sem USING (ord, page_num)) QUALIFY rank <= 8 AND score > 0.35),
near AS (
  SELECT pdf_id, ord, arg_min(page_num, abs(page_num - page_from) * 100 + rank) AS hit, list(page_num ORDER BY rank)[1:5] AS matched FROM hits GROUP BY pdf_id, ord),
docs AS (SELECT DISTINCT pdf_id FROM pages),
joined AS (
  SELECT pdf_id, ord, page_from, page_from + 2 AS page_to, hit, matched, lead(page_from) OVER (PARTITION BY pdf_id ORDER BY ord) AS nxt
  FROM docs CROSS JOIN items LEFT JOIN near USING (pdf_id, ord)),
started AS (SELECT *, CASE WHEN abs(hit - page_from) <= 2 THEN hit ELSE page_from END AS vf FROM joined)
SELECT pdf_id, ord, CAST(vf AS INT) AS vf, CAST(CASE WHEN vf < nxt THEN greatest(vf, nxt - 1) ELSE greatest(vf, page_to) END AS INT) AS vt,
  CASE WHEN hit IS NULL THEN 'toc_only' WHEN abs(hit - page_from) <= 2 THEN 'verified' ELSE 'weak_match' END AS status, coalesce(matched, []) AS matched
FROM started""")
def verify_items(spark, d):
    """Every benchmark text as an entry of every document."""
    pages = _pages(spark, d)
    items = base(spark, d, ITEMS)
    lex = retrieve.lexical_pairs(pages, items)
    keyed = pages.withColumn("_key", F.struct("pdf_id", "page_num"))
    sem = retrieve.similarity(keyed, items.select("ord", F.col("title").alias("question")), "_key", "ord").select("_key.*", "ord", "sem")
    score = F.coalesce("sem", F.lit(0.0)) * 2 + F.coalesce("lex", F.lit(0.0)) * 1.5
    scored = lex.join(sem, ["pdf_id", "page_num", "ord"], "full").withColumn("score", F.round(score, 9))
    hits = retrieve.rank_pages(scored, ["pdf_id", "ord"])
    entries = base(spark, d, "SELECT pdf_id, ord, title, page_from AS pageFrom, page_from + 2 AS pageTo FROM (SELECT DISTINCT source AS pdf_id FROM {documents}) AS d JOIN (" + ITEMS + ") AS i ON TRUE")
    out = retrieve.verify(entries, hits.select("pdf_id", "ord", "rank", "page_num"))
    return out.select("pdf_id", "ord", F.col("verifiedPageFrom").alias("vf"), F.col("verifiedPageTo").alias("vt"), F.col("verificationStatus").alias("status"), F.col("matchedPages").alias("matched"))
