"""The pipeline's near-dedup stage against brute-force similarity on planted near copies."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import near

WORDS = [f"w{k}" for k in range(3000)]


def word_shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(texts):
    """The ids that name the components of "Jaccard >= 0.8 on five words"."""
    sets = {k: word_shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = 0
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs += texts[a] != texts[b]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(k) for k in texts}, pairs


def planted(seed=7):
    rng = random.Random(seed)
    texts = []
    for n in (3, 30, 60, 120, 300, 900):
        for _ in range(8):
            words = rng.choices(WORDS, k=n)
            texts.append(words)
            for changes in (0, 1, max(1, n // 60), max(1, n // 45), max(1, n // 30)):
                copy = list(words)
                for _ in range(changes):
                    copy[rng.randrange(n)] = rng.choice(WORDS)
                texts.append(copy)
    rng.shuffle(texts)
    return {k: " ".join(t) if k % 2 else " ".join(t).upper() for k, t in enumerate(texts)}


def test_stage_against_brute_force(spark):
    texts = planted()
    want, pairs = brute(texts)
    assert pairs > 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("block", [2, 7])
def test_groups_of_many_cells(spark, block):
    texts = {k: t for k, t in planted(8).items() if k < 120}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near.dedup(docs, block=block).collect()} == brute(texts)[0]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (None, "x y z u v w"), (None, "other words of another text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.dedup(docs)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, [docs.collect()[k] for k in (0, 2, 5, 6)]))
    assert near.dedup(docs.limit(0)).count() == 0


def test_forest_counts_shared_shingles():
    a = np.arange(9, dtype="<u8")
    assert near.forest([a, np.arange(10, dtype="<u8"), np.arange(8, dtype="<u8")]) == [(1, 0), (2, 0)]
    assert near.forest([np.arange(8, dtype="<u8"), np.arange(1, 10, dtype="<u8")]) == []


def sent_to_cells(spark, monkeypatch, texts):
    """How many sets the second pass sends to cells, and the ids kept."""
    sent, found = [], near._found

    def counted(cells, similarity):
        sent.append(cells.count())
        return found(cells, similarity)

    monkeypatch.setattr(near, "_found", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in near.dedup(docs, block=32).collect()}
    monkeypatch.setattr(near, "_found", found)
    return sum(sent[1:]), kept


def test_unlinked_groups_grow_linearly(spark, monkeypatch):
    """Texts that share a passage of 60 words beside 40 of their own: one loose group, no links but two planted ones."""
    rng = random.Random(5)
    passage = rng.choices(WORDS, k=60)
    texts = {k: " ".join(passage + rng.choices(WORDS, k=40)) for k in range(800)}
    texts[900] = texts[11] + " one"
    texts[901] = "one " + texts[700]
    small = {k: t for k, t in texts.items() if k < 400 or k >= 900}
    n, kept = sent_to_cells(spark, monkeypatch, small)
    assert kept == brute(small)[0] == set(range(400)) | {901}
    m, kept = sent_to_cells(spark, monkeypatch, texts)
    assert kept == set(range(800))
    assert n <= 20 and m <= 20


def test_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Long texts that differ in one word have near fingerprints: SimHash's index brings them together, and nothing is left for the band keys."""
    rng = random.Random(9)
    texts, asked, left = {}, [], []
    for k in range(6):
        words = rng.choices(WORDS, k=3000)
        texts |= {10 * k: " ".join(words), 10 * k + 1: " ".join([*words[:-1], "other"]), 10 * k + 2: " ".join(["one", *words])}
    links, found = near.simhash.fingerprint_links, near._found
    monkeypatch.setattr(near.simhash, "fingerprint_links", lambda *a, **b: asked.append(1) or links(*a, **b))
    monkeypatch.setattr(near, "_found", lambda cells, similarity: left.append(cells.count()) or found(cells, similarity))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == brute(texts)[0] == {10 * k for k in range(6)}
    assert asked and sum(left) == 0


def test_passages_from_a_pool(spark):
    """Texts made of three shared passages each, some of which differ in few words: links over several blocks."""
    rng = random.Random(6)
    pool = [rng.choices(WORDS, k=40) for _ in range(12)]
    texts = {}
    for k in range(150):
        words = sum(rng.sample(pool, 3), [])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = rng.choice(WORDS)
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near.dedup(docs, block=5).collect()} == brute(texts)[0]
