"""Records, queues and their texts, with expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from quire.functions import status as S
from quire.functions import text as T
from quire.operators import classify, retrieve, store

KIND = "status string, retrieval string, bucket string, reason string, pending int, indexed boolean, chat boolean"


@pytest.mark.parametrize("row, expected", [
    (("failed", "", "review", "", 0, False, False), ("review", "Review Queue", "Failed", "Sent to review", "This PDF is fully ready in the backend library.")),
    (("Failed", "", "index", "", 2, False, False), ("error", "Needs Review", "Failed", "Ready", "Legacy partial record detected. Remaining pages are still pending vectorization.")),
    (("first_stage_running", None, None, None, None, None, None), ("running", "Processing", "Index Running", "Ready", "The index of the whole PDF is being built in the background.")),
    (("index_ready", "full_ingestion_waiting", "index", "", 3, True, False), ("staged", "Indexed Only", "Index Ready, Review Pending", "Finalized", "Legacy partial record detected. Remaining pages are queued for full ingestion.")),
    (("index_ready", "", "index", "", 0, True, False), ("indexed", "Indexed", "Index Ready", "Finalized", "This PDF is fully ready in the backend library.")),
    (("", "vectorized", "index", "odd", 0, False, True), ("review", "Review Queue", "Vectorized", "Sent to review", "Flagged for review: odd")),
    (("first_stage_waiting", "", "first_stage", "", 1, False, False), ("queued", "Pending Queue", "Waiting for Index", "Queued", "Uploaded; the whole PDF waits for its index. You may close the browser, the backend goes on.")),
    (("", "", "", "", 0, False, False), ("neutral", "Saved", "Unknown", "Ready", "This PDF is fully ready in the backend library.")),
])
def test_texts_of_a_record(spark, row, expected):
    c = F.col
    df = spark.createDataFrame([row], KIND)
    got = df.select(
        S.tone(c("status"), c("retrieval"), c("bucket"), c("reason"), c("pending"), c("indexed"), c("chat")).alias("t"), "*").select(
        "t", S.tone_label(c("t")), S.status_text(c("status"), c("retrieval")),
        S.step_label(c("status"), c("retrieval"), c("bucket"), c("reason"), c("indexed"), c("chat")),
        S.description(c("status"), c("retrieval"), c("bucket"), c("reason"), c("pending")))
    assert tuple(got.first()) == expected


def test_a_store_brings_its_own_words(spark):
    v = S.Vocabulary(waiting="todo", first_running="doing", first_bucket="batch", texts={"todo": "To do"}, descriptions=S.DESCRIPTIONS | {"queued": "Wait."})
    df = spark.createDataFrame([("a", "todo", "", "batch", 1), ("b", "doing", "", "batch", 1), ("c", "x", "", "batch", 1)], "pdf_id string, status string, retrieval string, queue_bucket string, updated_at int")
    assert [r.pdf_id for r in store.first_stage_queue(df, v).collect()] == ["a", "b"]
    row = df.select(S.status_text(F.col("status"), F.col("retrieval"), v), S.description(F.col("status"), F.col("retrieval"), F.col("queue_bucket"), F.lit(""), F.lit(0), v=v)).first()
    assert tuple(row) == ("To do", "Wait.")


@pytest.mark.parametrize("main, others, expected", [
    ((True, True, True, 9.0), [(True, True)], ("stuck", "Stuck")),
    ((True, True, True, 950.0), [], ("stopping", "Paused")),
    ((True, True, False, 950.0), [], ("stopping", "Stopping")),
    ((False, True, False, 950.0), [(False, True)], ("stopping", "Idle")),
    ((True, False, True, 950.0), [], ("paused", "Paused")),
    ((False, False, False, None), [(True, False)], ("running", "Idle")),
    ((False, False, False, None), [], ("idle", "Idle")),
])
def test_system_status(spark, main, others, expected):
    kind = "m struct<running:boolean,pausing:boolean,paused:boolean,beat:double>, o array<struct<running:boolean,stopping:boolean>>"
    df = spark.createDataFrame([(main, others)], kind)
    assert tuple(df.select(S.system_status(F.col("m"), F.col("o"), F.lit(1000.0)), S.runner_label(F.col("m"), F.lit(1000.0))).first()) == expected


def test_stage_labels(spark):
    df = spark.createDataFrame([("ocr_time",), ("new_stage_",), ("x",)], "k string")
    assert [r[0] for r in df.select(T.stage_label(F.col("k"), {"x": "An x"})).collect()] == ["OCR", "new stage", "An x"]


def test_clean_line_reads_marks_and_digits(spark):
    df = spark.createDataFrame([("“A’s”  – १२ t0 १५  T0O 7 t0p",)], "x string")
    assert df.select(T.clean_line(F.col("x"))).first()[0] == "\"A's\" - 12 to 15 to 7 t0p"


def test_queues_are_in_order(spark):
    kind = "pdf_id string, updated_at int, pending_pages int, deferred_decision string, queue_bucket string, status string"
    rows = [("c", 1, 2, "pending", "index", "s"), ("a", 2, 2, "pending", "index", "s"), ("b", 1, 2, "pending", "index", "s"), ("d", 0, 2, "skip", "index", "s"), ("e", 0, 2, None, "index", "s")]
    assert [r.pdf_id for r in store.pending_sql(spark.createDataFrame(rows, kind).repartition(4)).collect()] == ["b", "c", "a"]


def test_numbers_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(5)
    rows = store.numbered(df, [F.col("x")], "n", 7).collect()
    assert sorted((r.n, r.x) for r in rows) == [(k + 1, k) for k in range(1000)]


def test_record_list(spark):
    kind = ", ".join(f"{c} string" for c in store.RECORD_COLUMNS if c not in ("index_ready", "updated_at")) + ", index_ready boolean, updated_at int, created_at int"
    blank = {c: "" for c in store.RECORD_COLUMNS}
    rows = [blank | {"pdf_id": k, "filename": f, "index_ready": None, "updated_at": at, "created_at": 0} for k, f, at in (("a", "One.pdf", 1), ("b", "two.pdf", 3), ("c", "none.pdf", 2))]
    df = spark.createDataFrame(rows, kind)
    listed = store.record_list(df)
    assert listed.columns == list(store.RECORD_COLUMNS) and [r.pdf_id for r in listed.collect()] == ["b", "c", "a"] and listed.first().index_ready is False
    assert [r.pdf_id for r in store.record_list(df, " ONE ").collect()] == ["c", "a"]


def test_pages_fall_back_one_by_one(spark):
    kind = "pdf_id string, page_num int, text string"
    first, second = spark.createDataFrame([("d", 1, "a")], kind), spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], kind)
    assert [store.page_of(first, second, "d", n).first().text for n in (1, 2)] == ["a", "y"]
    assert store.page_of(first, second, "d", 3).count() == 0


def test_saved_indexes(spark):
    kind = "pdf_id string, index array<struct<title:string>>, created_at int, updated_at int"
    old = spark.createDataFrame([("a", [("x",)], 1, 1)], kind).withColumn("total_entries", F.lit(1))
    out = store.save_indexes(old, spark.createDataFrame([("a", [("y",), ("z",)], 5, 5)], kind)).first()
    assert (out.total_entries, out.created_at, out.updated_at) == (2, 1, 5)
    text = spark.createDataFrame([("a", '[{"title": "x"}]'), ("b", "broken")], "pdf_id string, index string")
    assert {r.pdf_id: [x.title for x in r["index"]] for r in store.read_index(text, "array<struct<title:string>>").collect()} == {"a": ["x"], "b": []}


@pytest.mark.parametrize("title, expected", [
    ("Table of  Contents", "Index"), ("VAKALATNAMA", "Vakalat Nama"), ("Reply to the notice", "Reply"), ("replying", None), ("विषय सूची", "Index"),
    ("List of dates", "List of Dates & Events"), ("e-court receipt", "e-Court Fee/Stamp Paper"), ("आदेश पत्र", "Order Sheet"), ("Judgement", "Judgment"), ("plain words", None),
])
def test_aliases(spark, title, expected):
    assert spark.range(1).select(classify.alias(F.lit(title))).first()[0] == expected


def test_lexical_pairs_against_brute_force(spark):
    import random
    import re

    rng = random.Random(4)
    words = ["the", "reply", "replying", "of", "party", "ab", "b", "notice", "x1", "über", "शपथ"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(60)]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)] + ["", "!", "eply", "ly", "tice of", "THE reply", "b the reply a"]
    pages = spark.createDataFrame([("d" if k % 2 else "e", k, t) for k, t in enumerate(texts)], "pdf_id string, page_num int, text string")
    items = spark.createDataFrame(list(enumerate(titles)), "ord int, title string")
    tokens = lambda t: [x for x in re.findall(r"\w+", t.lower()) if len(x) > 1]

    def lex(q, t):
        qt, tt = tokens(q), set(tokens(t))
        hits = sum(x in tt for x in qt)
        return hits + hits / len(set(qt)) + (2.5 if q.strip().lower() in t.lower() else 0) if qt else 0.0

    want = {(n, k): round(lex(q, t), 9) for n, t in enumerate(texts) for k, q in enumerate(titles) if lex(q, t)}
    got = {(r.page_num, r.ord): round(r.lex, 9) for r in retrieve.lexical_pairs(pages, items).collect()}
    assert got == want
    scored = {(r.page_num, r.ord) for r in retrieve.item_scores(pages, items.crossJoin(pages.select("pdf_id").distinct())).collect()}
    assert {p for p, v in want.items() if v * 1.5 > 0.35} <= scored
