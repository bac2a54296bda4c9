"""Retrieval over postings against scoring every page."""

import random

import pytest

from quire.operators import postings, retrieve

KIND = "pdf_id string, page_num int, text string"
WORDS = "order notice appeal court reply written party page annexure statement list dates evidence index witness".split()
ASKED = ["notice of appeal", "written reply", "reply", "the court order and the notice of dates", "", "!!", "zebra", "an", "rit", "statement of the party"]


def stored(spark, seed=3):
    rng = random.Random(seed)
    rows = [(d, n, " ".join(rng.choices(WORDS + ["the", "of", "a"] + [f"x{rng.randrange(400)}" for _ in range(60)], k=rng.randrange(0, 40)))) for d in "de" for n in range(1, 61)]
    rows += [("d", 70, "here is the Notice of Appeal"), ("d", 71, "notices of appealing"), ("d", 72, None), ("short", 1, "one page"), ("short", 2, "")]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def made(spark):
    pages = stored(spark).cache()
    return pages, postings.store(postings.post(pages))


@pytest.mark.parametrize("current", [None, 30])
def test_same_rows_as_scoring_every_page(spark, made, current):
    pages, index = made
    ids = ["d", "e", "short", "gone"]
    questions = spark.createDataFrame([(f"{q}|{d}", d, q, current) for q in ASKED for d in ids], "qid string, pdf_id string, question string, current int")
    got = {}
    for r in postings.retrieve_many(index, pages, questions).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.page_num, round(r.score, 6)))
    for q in ASKED[:4] + ASKED[-3:]:
        want = {}
        for r in retrieve.retrieve(pages, q, current=current).collect():
            want.setdefault(f"{q}|{r.pdf_id}", []).append((r["rank"], r.page_num, round(r.score, 6)))
        for d in ids:
            assert sorted(got.get(f"{q}|{d}", [])) == sorted(want.get(f"{q}|{d}", [])), (q, d)


def test_few_texts_are_read(spark, made):
    pages, index = made
    questions = spark.createDataFrame([("1", "d", "the court order and the notice of dates", None)], "qid string, pdf_id string, question string, current int")
    asked, met = postings._bounded(index, pages, questions)
    assert postings.survivors(asked, met, pages, 8).count() < 20 < pages.where("pdf_id = 'd'").count()


def test_empty_tables(spark, made):
    pages, index = made
    none = spark.createDataFrame([], "qid string, pdf_id string, question string, current int")
    assert postings.retrieve_many(index, pages, none).count() == 0
    empty = pages.limit(0)
    asked = spark.createDataFrame([("1", "d", "reply", 1)], none.schema)
    assert postings.retrieve_many(postings.post(empty), empty, asked).count() == 0
