"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints have 8 bytes. Two that differ in at most d bits differ in at most d bytes and so
share at least 8 - d positional bytes: the guaranteed minimum. Posting lists of single
bytes would hold 1/256 of all fingerprints each, so the index posts a fingerprint under combinations of
positional bytes: with positions split into two halves of four, five shared positions always put three
into one half, so the 8 triples within halves suffice for d = 3 (24-bit keys). For the pairs
that meet in a list, shared positional bytes are tallied from the pair itself, pairs below the minimum dropped, and
the rest verified bit by bit. The tally saves bit counts; the verification alone decides what is linked.

Equal fingerprints are merged before the index. A posting list of any length is dealt into cells
of two blocks each, so that every pair of it meets in exactly one cell of bounded size; a cell
returns a spanning forest of its links, not the links. Components are found by star
contraction over these forests, with a written table per round.

Defined cases: a null or empty text has fingerprint zero, linked like any other; a text shorter than
a shingle is one shingle; null ids join their component but never name it; repeated rows fall
into one component; an empty table gives an empty result; other columns are kept by dedup().
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, materialize
from quire.llm.graph import components

SHINGLE = 3
DISTANCE = 3
HASH_SEED = 42
#: Fingerprints per block; a cell holds two blocks.
BLOCK = 512
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    """The 64-bit SimHash of a whole text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    of = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - shingle + 1)
    rows = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(of, rows), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, shingle, seed) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    return F.pandas_udf(of, "long")


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = HASH_SEED) -> DataFrame:
    return df.withColumn("fp", _fingerprints(shingle, seed)(F.col(f"`{text}`")))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp) for every triple of positional bytes; the key holds the triple's number and bytes."""
    keys = []
    for slot, triple in enumerate(TRIPLES):
        key = F.lit(slot).cast("long")
        for position in triple:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255)))
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def cells(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, cell, fp): lists of one entry are dropped, long ones dealt so that each pair meets once."""
    sizes = posted.groupBy("key").count().where("count > 1")
    listed = posted.join(sizes, "key")
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    meets = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda j: F.shiftleft(F.least(own, j).cast("long"), 31).bitwiseOR(F.greatest(own, j).cast("long")),
        )
    )
    return listed.select("key", F.explode(meets).alias("cell"), "fp")


def forest(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group: fingerprint pairs (other, root) that connect each group's linked rows."""
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    shift = 1
    while len(left := left[left < len(fps) - shift]):
        left = left[group[left] == group[left + shift]]
        a, b = left, left + shift
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        x = fps[a] ^ fps[b]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of positional bytes
        near = shared >= 8 - distance
        near[near] = np.bitwise_count(x[near]) <= distance
        a, b = a[near], b[near]
        while len(a):
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(jumped := root[root], root):
                root = jumped
        shift += 1
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _linked(distance: int):
    def run(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["cell"] == pdf["cell"].iloc[-1])
            held, pdf = pdf[last], pdf[~last]
            yield pairs(pdf)
        if held is not None:
            yield pairs(held)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        key, cell = pdf["key"].to_numpy(), pdf["cell"].to_numpy()
        new = np.ones(len(pdf), bool)
        new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        u, v = forest(np.cumsum(new), pdf["fp"].to_numpy().view(np.uint64), distance)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}).drop_duplicates()

    return run


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) whose components are those of "at most distance bits apart" among distinct fps."""
    if not 0 <= distance <= 3:
        raise ValueError("the index guarantees distances 0 to 3")
    dealt = cells(postings(fps), block)
    together = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return together.mapInPandas(_linked(distance), "u long, v long").distinct()


def cluster(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; the id is the smallest doc_id reachable."""
    printed = materialize(with_fingerprint(docs.select("doc_id", "text"), "text", shingle).select("doc_id", "fp"))
    return with_components(printed, distance, block).select("doc_id", "fp", "component_id")


def with_components(printed: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Add component_id, and root (one fingerprint of the component), to rows that have doc_id and fp."""
    nodes = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(fingerprint_links(nodes.select("fp"), distance, block))
    rooted = nodes.join(reached, nodes.fp == reached.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").select("fp", "root", "component_id")
    return printed.join(known, "fp")


def dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component: the one whose id names it, with the columns of docs.

    Rows that repeat the naming id are told apart by their places in a written table; a component of
    null ids only keeps one of its rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    printed = materialize(
        with_fingerprint(docs.select(row, "doc_id", "text"), "text", shingle).drop("text").withColumn("_place", F.monotonically_increasing_id())
    )
    placed = with_components(printed.select("doc_id", "fp", "_place"), distance)
    first = placed.groupBy("root").agg(
        F.min_by("_place", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_place"))).alias("_place"),
    )
    return printed.join(first.select("_place"), "_place", "left_semi").select("_row.*")
