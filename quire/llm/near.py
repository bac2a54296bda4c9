"""Near copies by word-shingle similarity: SimHash fingerprints find copies, banded minima the rest, shared shingles decide.

Two texts are linked if their sets of word shingles (64-bit hashes) have a Jaccard similarity of at
least SIMILARITY. First their SimHash fingerprints meet in the byte-position index with count filtering (see simhash), and groups of
fingerprints at most three bits apart are compared exactly. A fixed-width fingerprint cannot promise all links: at a similarity of 0.8 SimHash
differs in about ten of 64 bits, with a wide spread. So what the fingerprints leave apart goes an exact way: a set is posted under BANDS keys of
ROWS minima each, and keys whose sets are all linked already are passed over. A pair of similarity s shares no key with a probability of
(1 - s**ROWS) ** BANDS, which is 7e-10 at 0.8 and less above.

Texts of equal sets are merged first. Texts that share keys form loose groups. A group of at most a block is one cell; in a
larger one a block meets all others, which links copies, and what is still apart meets by rare shingles: two sets linked at
4/5 share one of the fifth of their shingles that comes first in any order fixed for all, here the rarest first. So texts that
share only a frequent passage don't meet. A cell links its texts by exact counts and returns a spanning forest of its links.

Defined cases: a null or empty text is one empty shingle, a text shorter than a shingle is one
shingle; null ids join their component and lose to other ids; repeated rows fall into one component.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.common import LOWER, UPPER, materialize, release
from quire.llm.graph import components

SHINGLE = 5
#: The least similarity of linked texts, as a fraction.
SIMILARITY = (4, 5)
HASH_SEED = 42
BANDS, ROWS = 40, 4
#: Sets per block; a cell holds two blocks.
BLOCK = 256
#: Slots by which shared shingles are bounded before they are counted.
SLOTS = 1 << 18
#: Bits per key of a sieve, and its most bits.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 27
#: Numbers of sets from which on a shingle counts as more frequent.
LEVELS = (2, 16, 128, 1024, 8192)

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RNG = np.random.default_rng(HASH_SEED)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    rows = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=HASH_SEED), rows), dtype="<u8"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's number and its minima."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(high), 1 << 11):
        seen = np.multiply.outer(_TIMES, high[k : k + (1 << 11)])
        seen += _PLUS[:, None]
        np.minimum(least, seen.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), seed=k) for k, b in enumerate(bands)), dtype=np.uint64, count=BANDS).view(np.int64)


def _sketches(shingle: int):
    def of(texts: pd.Series) -> pd.DataFrame:
        ids, prints, keys = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64), np.empty((len(texts), BANDS), "<i8")
        for k, t in enumerate(texts):
            hashes = shingles(t, shingle)
            ids[k], prints[k], keys[k] = xxhash.xxh64_intdigest(hashes.tobytes()), simhash.fingerprint(t, shingle), band_keys(hashes)
        return pd.DataFrame({"fp": ids.view(np.int64), "print": prints.view(np.int64), "keys": list(keys)})

    return F.pandas_udf(of, "fp long, print long, keys array<long>")


def _sets(shingle: int):
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).tobytes() for t in texts], dtype=object)

    return F.pandas_udf(of, "binary")


def _width(keys: int) -> int:
    """The bits of a sieve for so many keys, a power of two."""
    return min(SIEVE_MOST, max(64, 1 << int(keys * SIEVE_BITS).bit_length()))


def _table(places: DataFrame, bits: int) -> np.ndarray:
    """A bit set of the places in column at."""
    word = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("mask"))
    words = word.toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return table


def _holds(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sieve(keys: DataFrame):
    """A test for columns: true for every key of the one-column table keys, and for few others.

    One bit per hashed key comes to the driver and goes to the executors; the exact join follows.
    """
    bits = _width(keys.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    held = keys.sparkSession.sparkContext.broadcast(_table(keys.select(place(F.col(keys.columns[0])).alias("at")), bits))

    def of(at: pd.Series) -> pd.Series:
        return pd.Series(_holds(held.value, at.to_numpy().astype(np.uint64)))

    test = F.pandas_udf(of, "boolean")

    def maybe(key: Column) -> Column:
        return test(place(key))

    return maybe


def forest(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of places (found, from) that connect all sets linked in this list.

    Every set is counted once against those not yet reached, so a group of copies costs little.
    """
    over, under = similarity
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    own = [(s & np.uint64(SLOTS - 1)).astype(np.uint32) for s in sets]
    mark = np.zeros(SLOTS, bool)
    waiting = np.ones(len(sets), bool)
    left, joined, starts = np.arange(len(sets)), np.concatenate(own), np.cumsum(sizes) - sizes
    out, queue = [], []
    for k in range(len(sets)):
        if not waiting[k]:
            continue
        waiting[k] = False
        queue.append(k)
        while queue:
            p = queue.pop()
            alive = np.flatnonzero(waiting[left])
            if not len(alive):
                continue
            if 2 * len(alive) < len(left):
                left = left[alive]
                joined = np.concatenate([own[i] for i in left])
                starts = np.cumsum(sizes[left]) - sizes[left]
            mark[own[p]] = True
            most = np.add.reduceat(mark[joined], starts, dtype=np.int64)  # no less than the shared shingles
            mark[own[p]] = False
            for i in left[waiting[left] & (under * most >= over * (sizes[p] + sizes[left] - most))].tolist():
                shared = len(np.intersect1d(sets[p], sets[i], assume_unique=True))
                if under * shared >= over * (sizes[p] + sizes[i] - shared):
                    waiting[i] = False
                    out.append((i, p))
                    queue.append(i)
    return out


def _linked(similarity: tuple[int, int]):
    def run(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["group"] == pdf["group"].iloc[-1]) & (pdf["cell"] == pdf["cell"].iloc[-1])
            held, pdf = pdf[last], pdf[~last]
            yield pairs(pdf)
        if held is not None:
            yield pairs(held)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, g = [], [], []
        for (group, _), cell in pdf.groupby(["group", "cell"], sort=False):
            fps = cell["fp"].to_numpy()
            for i, p in forest([np.frombuffer(s, "<u8") for s in cell["hashes"]], similarity):
                u.append(fps[i])
                v.append(fps[p])
                g.append(group)
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64), "group": np.array(g, np.int64)})

    return run


def _found(cells: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Edges (u, v, group) of the cells (group, cell, fp, hashes) of loose groups."""
    return _compared(cells, similarity)


def _compared(cells: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Edges (u, v, group) of cells (group, cell, fp, hashes)."""
    together = cells.repartition("group", "cell").sortWithinPartitions("group", "cell", "fp")
    return materialize(together.mapInPandas(_linked(similarity), "u long, v long, group long").distinct())


def _cell(main: Column, rest: Column) -> Column:
    """The number of the cell of a block of the largest component and a block of the rest."""
    return F.shiftleft(main.cast("long"), 31).bitwiseOR(rest.cast("long"))


def alike_groups(nodes: DataFrame) -> DataFrame:
    """(fp, group) for sets whose fingerprints differ in at most three bits, directly or over further ones: SimHash's index."""
    reached = components(simhash.fingerprint_links(nodes.select(F.col("print").alias("fp")).distinct()))
    named = nodes.join(reached, nodes.print == reached.node, "left").select("fp", F.coalesce("root", "print").alias("group"))
    return named.join(named.groupBy("group").agg(F.count("*").alias("sets")).where("sets > 1").select("group"), "group").select("fp", "group")


def loose_groups(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, group) for sets that share a band key with sets that are not linked to them yet, directly or over further sets; linked: (node, root)."""
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "keys", F.coalesce("root", "fp").alias("root"))
    posted = rooted.select("fp", "root", F.explode("keys").alias("key"))
    several = [F.min("root").alias("a"), F.max("root").alias("b")]
    least = posted.groupBy("key").agg(F.min("fp").alias("least"), *several).where("a != b").select("key", "least")
    edges = posted.join(least, "key").where("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    return components(edges).select(F.col("node").alias("fp"), F.col("root").alias("group"))


def _sent(printed: DataFrame, nodes: DataFrame, grouped: DataFrame, shingle: int, block: int) -> DataFrame:
    """(fp, group, blocks, hashes) of the sets in grouped (fp, group), read from one text each."""
    places = materialize(grouped.join(nodes, "fp").select("fp", "group", F.col("first._place").alias("_place")))
    maybe = sieve(places.select("_place"))
    texts = printed.select("_place", F.col("_row.text").alias("text")).where(maybe(F.col("_place")))
    blocks = places.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # sort-merge at every size: a table of places is small only beside a small corpus
    held = materialize(places.join(blocks, "group").hint("merge").join(texts, "_place").select("fp", "group", "blocks", _sets(shingle)(F.col("text")).alias("hashes")))
    release(places)
    return held


def _dealt_first(held: DataFrame) -> DataFrame:
    """Cells (group, cell, fp, hashes) in which the first block of a group meets every other one."""
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meets = F.when((F.col("blocks") > 1) & (mine == 0), F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(mine))
    return held.select("group", F.explode(meets.cast("array<long>")).alias("cell"), "fp", "hashes")


def links(printed: DataFrame, nodes: DataFrame, shingle: int, similarity: tuple[int, int], block: int) -> DataFrame:
    """Edges (u, v) whose components are those of "at least this similar" among the sets of nodes.

    Groups of near fingerprints are compared first; what they link is not compared again unless a set of another component shares a band key.
    A group of more than a block is dealt into blocks, and the first block meets every other one: so each set is
    sent once, and the sets of a group of copies find each other through it. What is left to compare in loose groups are sets of different
    components that share a rare shingle.
    """
    alike = materialize(alike_groups(nodes))
    copies = _sent(printed, nodes, alike, shingle, block)
    first = _compared(_dealt_first(copies), similarity)
    linked = materialize(components(first.select("u", "v")))
    release(alike, copies)
    grouped = materialize(loose_groups(nodes, linked))
    held = _sent(printed, nodes, grouped, shingle, block)
    near = _found(_dealt_first(held), similarity)
    large = held.where("blocks > 1")
    rooted = _rooted(large.select("fp", "group"), near, linked)
    mixed = rooted.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("group")
    apart = materialize(rooted.join(mixed, "group", "left_semi").select("fp", "root"))
    if apart.isEmpty():
        release(grouped, held, rooted, apart, linked)
        return first.select("u", "v").unionAll(near.select("u", "v")).distinct()
    still = materialize(large.join(apart.hint("merge"), "fp").select("fp", "root", "hashes"))
    far = _found(_dealt(still, meetings(still, similarity), block), similarity)
    release(grouped, held, rooted, apart, still, linked)
    return first.select("u", "v").unionAll(near.select("u", "v")).unionAll(far.select("u", "v")).distinct()


def _rooted(sets: DataFrame, edges: DataFrame, linked: DataFrame) -> DataFrame:
    """Add to sets (fp, group) the root of their component by edges and by what is linked (node, root) already."""
    before = linked.where("node != root").join(sets.select(F.col("fp").alias("node")), "node", "left_semi").select(F.col("node").alias("u"), F.col("root").alias("v"))
    own = edges.join(sets.select("group").distinct(), "group", "left_semi").select("u", "v").unionAll(before)
    reached = components(own)
    return materialize(sets.join(reached, sets.fp == reached.node, "left").select("fp", "group", F.coalesce("root", "fp").alias("root")))


def _prefix(tables: list[np.ndarray], similarity: tuple[int, int]):
    """The shingles of a set that come first, the rarest before, without those of one component only.

    Two sets linked at over/under share one of their first n - ceil(n * over / under) + 1 shingles in any order that
    depends on the shingle alone; so sieves may take a rare shingle for a frequent one.
    """
    over, under = similarity

    def of(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            hashes = np.frombuffer(s, "<u8")
            rank = np.zeros(len(hashes), np.uint8)
            for table in tables.value:
                rank += _holds(table, hashes & np.uint64(64 * len(table) - 1))
            first = np.lexsort((hashes, rank))[: len(hashes) + over * len(hashes) // -under + 1]
            out.append(hashes[first[rank[first] > 0]].view("<i8"))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<long>")


def meetings(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(fp, group) for those of sets (fp, root, hashes) that share a rare shingle with one of another root, directly or over further sets.

    Sets of one root are linked already. Beyond what the sieves hold all shingles count as frequent, and the result keeps whole.
    """
    spark = sets.sparkSession
    of = F.pandas_udf(lambda s: s.map(lambda b: np.frombuffer(b, "<i8")), "array<long>")
    several = [F.min("root").alias("a"), F.max("root").alias("b")]
    seen = sets.select("root", F.explode(of("hashes")).alias("token")).groupBy("token").agg(F.count("*").alias("sets"), *several)
    shared = materialize(seen.where("a != b").select("token", "sets"))
    tables = []
    for level in LEVELS:
        tokens = shared.where(F.col("sets") >= level)
        if n := tokens.count():
            tables.append(_table(tokens.select(F.col("token").bitwiseAND(F.lit(_width(n) - 1)).alias("at")), _width(n)))
    release(shared)
    posted = materialize(sets.select("fp", "root", F.explode(_prefix(spark.sparkContext.broadcast(tables), similarity)("hashes")).alias("token")))
    least = posted.groupBy("token").agg(F.min("fp").alias("least"), *several).where("a != b").select("token", "least")
    edges = posted.join(least, "token").where("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    return components(edges).select(F.col("node").alias("fp"), F.col("root").alias("group"))


def _dealt(sets: DataFrame, met: DataFrame, block: int) -> DataFrame:
    """Cells (group, cell, fp, hashes) in which the sets outside a group's largest component meet all others of the group."""
    named = materialize(met.join(sets.select("fp", "root"), "fp"))
    sizes = named.groupBy("group", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"),
        F.ceil((F.sum("n") - F.max("n")) / block).cast("int").alias("rests"), F.ceil(F.max("n") / block).cast("int").alias("mains"))
    dealt = named.join(main, "group").hint("merge").join(sets.select("fp", "hashes"), "fp")
    in_rest, in_main = (F.pmod(F.xxhash64("fp"), F.col(c)).cast("int") for c in ("rests", "mains"))
    own = F.transform(  # cells of two blocks of the rest, told apart from the others by their sign
        F.filter(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: j != in_rest),
        lambda j: -1 - F.shiftleft(F.least(in_rest, j).cast("long"), 31).bitwiseOR(F.greatest(in_rest, j).cast("long")))
    as_rest = F.concat(own, F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: _cell(j, in_rest)))
    as_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: _cell(in_main, i))
    return dealt.select("group", F.explode(F.when(F.col("root") != F.col("main"), as_rest).otherwise(as_main)).alias("cell"), "fp", "hashes")


def dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One document of each component of linked texts: that of the least id, with the columns of docs.

    Rows that repeat an id are told apart by their places in a written table. Only documents that the
    sieve takes for dropped ones meet the exact anti join; the others pass as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sketched = docs.select(row, "doc_id", _sketches(shingle)(F.col("text")).alias("s"))
    printed = materialize(sketched.select("_row", "doc_id", "s.fp", "s.print", "s.keys").withColumn("_place", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_place"))
    nodes = materialize(printed.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("rows"), F.min("print").alias("print"), F.first("keys").alias("keys")))
    reached = components(links(printed, nodes, shingle, similarity, block))
    rooted = nodes.join(reached, nodes.fp == reached.node, "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).where("rows > 1")
    known = rooted.select("fp", "root").join(named, "root").select("fp", F.col("first._place").alias("_keep"))
    dropped = materialize(printed.select("fp", "_place").join(known, "fp").where("_place != _keep").select("_place"))
    maybe = sieve(dropped)(F.col("_place"))
    sure = printed.where(~maybe).select("_row.*")
    return sure.unionAll(printed.where(maybe).join(dropped.hint("merge"), "_place", "left_anti").select("_row.*"))
