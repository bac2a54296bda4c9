"""Hybrid retrieval over stored postings: many questions at once, texts read only where they can decide.

A page's score for a question is that of retrieve.retrieve. Its semantic part, its whole words and its proximity
come from postings; only the phrase and words inside longer words need the text. So postings bound every score
from below and above, and a page whose upper bound misses the k-th lower bound of its question is left out unread.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import embed
from quire.functions import text as T
from quire.operators import retrieve
from quire.sources.work import freeze

#: How far a sum of doubles may be off.
EDGE = 1e-6
KEYS = ["qid", "pdf_id", "page_num"]


class Postings(NamedTuple):
    """(idx, pdf_id, page_num, value) and (token, pdf_id, page_num): the dimensions and the words of pages."""

    dims: DataFrame
    words: DataFrame


def post(pages: DataFrame) -> Postings:
    """The postings of pages (pdf_id, page_num, text), dealt by ranges, so that a frequent word fills several tasks and files tell which words they hold."""
    low = F.lower(F.coalesce("text", F.lit("")))
    vector = pages.select("pdf_id", "page_num", embed.sparse(low).alias("_v")).select("pdf_id", "page_num", F.explode(F.arrays_zip("_v.idx", "_v.value")).alias("_p"))
    dims = vector.select(F.col("_p.idx").alias("idx"), "pdf_id", "page_num", F.col("_p.value").alias("value"))
    words = pages.select(F.explode(F.array_distinct(T.tokens(low))).alias("token"), "pdf_id", "page_num")
    return Postings(*(df.repartitionByRange(*by).sortWithinPartitions(*by) for df, by in ((dims, ("idx", "pdf_id", "page_num")), (words, ("token", "pdf_id", "page_num")))))


def store(postings: Postings) -> Postings:
    """The postings, written once."""
    return Postings(*map(freeze, postings))


def _bounded(postings: Postings, pages: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions with their parts, and (qid, pdf_id, page_num, sem, hits, ..., low, high) of the pages that postings or proximity find."""
    asked = freeze(questions.select(
        "qid", "pdf_id", "current", F.lower(T.strip(F.col("question"))).alias("_phrase"), T.tokens(F.col("question")).alias("_t"), embed.sparse(F.col("question")).alias("_v")))
    asked = asked.withColumns({"_n": F.size("_t"), "_d": F.size(F.array_distinct("_t"))})
    dims = asked.select("qid", "pdf_id", F.explode(F.arrays_zip("_v.idx", "_v.value")).alias("_p")).select("qid", "pdf_id", F.col("_p.idx").alias("idx"), F.col("_p.value").alias("_q"))
    words = asked.select("qid", "pdf_id", F.explode("_t").alias("token")).groupBy("qid", "pdf_id", "token").agg(F.count("*").cast("double").alias("hits"))
    near = asked.where("current IS NOT NULL").select("qid", "pdf_id", F.explode(F.sequence(F.col("current") - retrieve.NEAR, F.col("current") + retrieve.NEAR)).alias("page_num"))
    zero = F.lit(0.0)
    sem = postings.dims.join(dims, ["pdf_id", "idx"]).select(*KEYS, (F.col("value") * F.col("_q")).alias("sem"), zero.alias("hits"))
    hits = postings.words.join(words, ["pdf_id", "token"]).select(*KEYS, zero.alias("sem"), "hits")
    close = pages.select("pdf_id", "page_num").join(near, ["pdf_id", "page_num"]).select(*KEYS, zero.alias("sem"), zero.alias("hits"))
    met = sem.unionByName(hits).unionByName(close).groupBy(*KEYS).agg(F.sum("sem").alias("sem"), F.sum("hits").alias("hits"))
    parts = met.join(asked.select("qid", "current", "_n", "_d"), "qid")
    whole = F.col("hits") / F.greatest("_n", F.lit(1))
    low = 2 * F.col("sem") + _lexical() + T.proximity(F.col("page_num"), F.col("current")) + whole
    # a phrase leaves at most its first and last word as parts of longer words
    more = F.when(F.col("_n") > 0, 1 - whole).otherwise(0.0) + F.when((F.col("_n") > 0) & (F.col("hits") >= F.col("_n") - 2), T.PHRASE).otherwise(0.0)
    return asked, freeze(parts.select(*KEYS, "sem", "hits", low.alias("low"), (low + more).alias("high")))


def _lexical() -> Column:
    return F.when(F.col("_n") > 0, F.col("hits") + F.col("hits") / F.col("_d")).otherwise(0.0)


def survivors(asked: DataFrame, met: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """(qid, pdf_id, page_num): the pages whose text has to be read.

    A question whose k-th lower bound doesn't exceed what a page without any posting can reach takes all pages of its document.
    """
    order = W.partitionBy("qid").orderBy(F.desc("low"))
    best = met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("qid").agg(F.min("low").alias("_least"), F.count("*").alias("_found"))
    unseen = F.when(F.col("_n") > 0, 1.0).otherwise(0.0) + F.when(F.col("_n").between(1, 2), T.PHRASE).otherwise(0.0)
    judged = asked.select("qid", "pdf_id", unseen.alias("_unseen")).join(best, "qid", "left").withColumn(
        "_all", (F.coalesce("_found", F.lit(0)) < k) | (F.col("_least") <= F.col("_unseen") + EDGE))
    whole = pages.select("pdf_id", "page_num").join(judged.where("_all").select("qid", "pdf_id"), "pdf_id").select(*KEYS)
    few = met.join(judged.where("NOT _all").select("qid", "_least"), "qid").where(F.col("high") >= F.col("_least") - EDGE).select(*KEYS)
    return few.unionByName(whole)


def retrieve_many(postings: Postings, pages: DataFrame, questions: DataFrame, k: int = retrieve.DEFAULT_K) -> DataFrame:
    """(qid, pdf_id, page_num, sem, lex, prox, tp, score, rank): the best pages for every question in its document.

    pages: (pdf_id, page_num, text), unique by both, of which post made the postings. questions: (qid, pdf_id, question,
    current), qid unique; current is a page number or null. The rows are those of retrieve.retrieve; scores that agree to nine digits are ties, told apart by page.

    Defined cases: a question without words is scored by its vector and by proximity; a question of a document without
    pages has no row; if no page scores above 0, the last k pages are returned.
    """
    asked, met = _bounded(postings, pages, questions)
    wanted = survivors(asked, met, pages, max(retrieve.MIN_K, k))
    known = wanted.join(met.select(*KEYS, "sem", "hits"), KEYS, "left").fillna(0.0, ["sem", "hits"])
    read = known.join(pages.select("pdf_id", "page_num", F.lower(F.coalesce("text", F.lit(""))).alias("_low")), ["pdf_id", "page_num"])
    full = read.join(asked.drop("_v", "pdf_id"), "qid")
    phrase = F.when((F.col("_n") > 0) & F.contains("_low", "_phrase"), T.PHRASE).otherwise(0.0)
    inside = F.size(F.filter("_t", lambda t: F.contains(F.col("_low"), t))) / F.greatest("_n", F.lit(1))
    scored = full.select(*KEYS, "sem", (_lexical() + phrase).alias("lex"), T.proximity(F.col("page_num"), F.col("current")).alias("prox"), inside.alias("tp"))
    total = 2 * F.col("sem") + F.col("lex") + F.col("prox") + F.col("tp")
    ranked = retrieve.top_k_positive(scored.withColumn("_total", total).withColumn("score", F.round("_total", 9)), ["qid", "pdf_id"], k)
    return ranked.withColumn("score", F.col("_total")).drop("_total")
