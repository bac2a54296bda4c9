"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import license_scan, mixing, ogg, packing, pii, quality, sharding, simhash, toxicity, url_filter

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
WORDS = " ".join("".join(chr(97 + (i * (j + 3) + i // 26 + j) % 26) for j in range(3 + i % 4)) + "." * (i % 10 == 9) for i in range(120))
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string, size string, fp string, n_words string"
ROWS = [
    (1, None, "en", "a", 0, 0.1, "x", "s", "f", "n"),
    (2, "", "en", None, 0, None, None, None, None, None),
    (3, WORDS, "en", "a", 9, 0.2, "x", "s", "f", "n"),
    (3, WORDS, "en", "a", 9, 0.2, "x", "s", "f", "n"),
    (4, WORDS, None, "b", 9, 0.2, "x", "s", "f", "n"),
    (None, WORDS + " more", "en", "b", 9, 0.2, "x", "s", "f", "n"),
    (5, LONG, "en", "c", None, 0.2, "x", "s", "f", "n"),
    (6, "a\n\n \t b", "en", "", 9, 0.2, "x", "s", "f", "n"),
    (7, "x" * 200_000, "en", "d", 9, 0.2, "x", "s", "f", "n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_ogg(docs, none):
    def stored(df):
        return ogg.load_media(ogg.store_media(df, ogg.padded_payload(F.col("text"))))

    rows = stored(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        raw = (r.text or "").encode()
        assert bytes(r.ogg.payload) == raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert r.ogg.bad_pages == 0
    assert len({bytes(r.media) for r in rows if r.text == WORDS}) == 1
    assert stored(none).count() == 0
    assert ogg.packet_rows(ogg.store_media(docs, ogg.padded_payload(F.col("text"))), "doc_id").where("doc_id = 1").count() == 3


def test_ogg_null_media(spark):
    assert ogg.load_media(spark.sql("SELECT CAST(NULL AS BINARY) AS media")).first().ogg.payload is None


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, None), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels) is None
    assert {r.score for r in toxicity.with_score(docs, None).collect()} == {0.0}
    model = toxicity.fit([f"you idiot number {i} clown" for i in range(30)], [f"a calm text number {i} here" for i in range(60)])
    rows = toxicity.with_score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.with_score(none, model).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)
    assert [r.target for r in rows if r.source is None] == [0.0]
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_simhash(docs, none):
    rows = simhash.cluster(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == 0 and by[1].component_id == 1 and by[2].component_id == 1
    assert by[3].component_id == 3 and by[4].component_id == 3
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert len([r for r in kept.collect() if r.text == WORDS]) == 1
    assert simhash.cluster(none).count() == 0 and simhash.dedup(none).count() == 0


def test_components_of_null_ids_stay_apart(spark):
    df = spark.createDataFrame([(None, "one two three four"), (None, "completely different words here now")], "doc_id long, text string")
    assert simhash.dedup(df).count() == 2


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {16}
    assert sharding.shard_documents(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, capacity=512).collect()
    assert sorted({r.doc_id for r in rows}, key=str) == sorted({r[0] for r in ROWS}, key=str)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 512
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack_documents(none).count() == 0


def test_pii(docs, none):
    out = pii.pseudonymize(docs, kinds="kinds")
    assert out.columns == [*docs.columns, "kinds"]
    assert [(r.doc_id, r.text) for r in out.collect()] == [(r[0], r[1]) for r in ROWS]
    assert pii.pseudonymize(none).count() == 0


def test_license_scan(docs, none):
    rows = license_scan.digest(license_scan.scan_licenses(docs)).collect()
    assert len(rows) == len(ROWS)
    assert {(r.labels, r.first_word, r.score) for r in rows} == {("", None, 0.0)}
    assert license_scan.scan_licenses(none).count() == 0


CLASHES = ("_new", "_text", "_hit", "_scan", "_before", "pattern", "posterior", "row", "_row", "_place", "_part", "_start", "media_", "kept", "_SCAN", "fp", "keys", "group", "cell", "u", "v", "node", "root", "copies", "_rate")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose other columns have names that operators use inside."""
    names = [n for n in CLASHES if n != "_SCAN"]
    rows = [(k, WORDS + f" number {k} of 5105105105105100", "s", 9, *["own"] * len(names)) for k in range(4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, clashing, name, stage):
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns and out.count() > 0
    assert all(r[n] == "own" for r in out.collect() for n in clashing.columns[4:])


def test_operators_keep_clashing_columns(spark, clashing):
    rest = [c for c in clashing.columns if c not in ("kept", "posterior", "doc_id", "text", "source", "n_chars")]
    judged = quality.judge(clashing)
    scanned = license_scan.scan_licenses(clashing)
    masked = pii.pseudonymize(clashing, kinds="found")
    urls = url_filter.judge_urls(clashing.withColumn("url", F.lit("http://x.com/")), [("block", "com", "/")])
    joined = url_filter.judge_urls(clashing.withColumn("url", F.lit("http://x.com/")), [("block", "com", "/")], max_trie_bytes=0)
    scored = toxicity.with_score(clashing, None)
    for out in (judged, scanned, masked, urls, joined, scored):
        rows = out.collect()
        assert len(rows) == 4 and all(r[n] == "own" for r in rows for n in rest)
    assert {type(r.posterior) for r in judged.collect()} == {float} and masked.first().found == ["card"]
    assert {r.rule for r in urls.collect()} == {r.rule for r in joined.collect()} == {"com/"}


def test_url_rules_lower_only_ascii(spark):
    df = spark.createDataFrame([(1, "http://Ä.COM/"), (2, "http://ä.com/")], "page_id long, url string")
    for size in (1 << 20, 0):
        rows = url_filter.judge_urls(df, [("block", "Ä.Com", "/")], max_trie_bytes=size).orderBy("page_id").collect()
        assert [(r.host, r.verdict) for r in rows] == [("Ä.com", "block"), ("ä.com", "allow")]


def test_trie_is_plain_data():
    import json
    import pickletools

    import pickle

    root = url_filter.trie([("block", "a.com", "/x/y"), ("allow", "", "/")])
    assert not [a for op, a, _ in pickletools.genops(pickle.dumps(root)) if op.name in ("GLOBAL", "STACK_GLOBAL")], json
    assert url_filter.find(root, "b.a.com", "/x/yz") == ("a.com/x/y", "block")


def test_ties(spark):
    """Equal votes are judged alike; equal seeds and equal lengths are dealt the same way every time."""
    df = spark.createDataFrame([(k, WORDS, "a" if k % 2 else "b") for k in range(12)], "doc_id long, text string, source string")
    assert len({r.posterior for r in quality.judge(df).collect()}) == 1
    once, again = (sorted(map(tuple, mixing.mix_plan(df.repartition(n)).select("doc_id", "taken").collect())) for n in (1, 5))
    assert once == again
    pieces = [sorted(map(tuple, packing.pack_documents(df.repartition(n), capacity=512).select("doc_id", "sequence_id", "offset").collect())) for n in (1, 5)]
    assert pieces[0] == pieces[1]


def test_url_filter(spark):
    kind = "page_id long, url string, host string, verdict string"
    df = spark.createDataFrame([(1, None, "h", "v"), (2, "no scheme", "h", "v"), (3, "http://", "h", "v"), (4, "http://COM/", "h", "v"), (4, "http://COM/", "h", "v"), (5, "http://" + "a." * 5000 + "com/x", "h", "v")], kind)
    rows = url_filter.judge_urls(df, [("allow", "com", "/")], default="block").collect()
    assert [(r.page_id, r.rule, r.verdict) for r in rows] == [(1, None, "block"), (2, None, "block"), (3, None, "block"), (4, "com/", "allow"), (4, "com/", "allow"), (5, "com/", "allow")]
    assert rows[3].host == "com"
    assert url_filter.judge_urls(df.limit(0), []).count() == 0


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].base_failed and not by[1].kept and by[3].n_words == 120
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert quality.judge(none).count() == 0 and quality.filter_documents(none).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, name, stage):
    """Every stage takes nasty rows with extra columns, and an empty table."""
    out = stage(spark, docs, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, none, "").count() == 0
