"""Cross-tokenizer alignment: where two tokenizers cut alike, which of their tokens overlap, and how often they do so.

A (byte-level BPE) reads a space and the text, B (pieces with byte fallback) the text, before which it puts a space itself. Both give the same bytes.
A batch's texts are put one after another, with byte offsets; the ends of A's and of B's tokens are counted by byte, both at once (bincount), and
the batch is cut where both end. An interval between neighbouring ends of either kind lies in one token of A and one of B, and each overlapping
pair has one such interval: so links are read off the merged ends, and running sums over them give every figure of a text by subtraction.

Neither tokenizer crosses a blank that follows no other blank and comes before a character that is none: A's words begin there, and no piece of B has a
blank inside (checked when the model is read). Texts are therefore parted there, and what is put one after another are the *distinct* parts of the batch; a
text's figures are sums over its parts. Texts with other blanks in such places are one part each, and so are all texts if B has pieces with a blank inside.

What is stored between the two passes is a row per text, with its distinct pairs and how often each links in it: few bytes for each link, no cell larger than its own
text asks for, and a copy of a pair in a text looked up once. How often an id pair is linked in the corpus is counted by batch and partition before the shuffle, in the first
pass already: these counts are rows of the same table with columns of their own, so links are not read again for them. The most frequent pairs, at most MOST_PAIRS, go to all
executors; a text's other pairs, none of which is frequent, meet their counts in a join. The greatest count of a B id is a row per id.

Defined cases: a null or empty text has no tokens, zeros and an empty checksum; so has one whose tokens' bytes are not those of the text (a text with the
piece mark itself, which B reads as a blank); such texts count nowhere. Strings of special tokens are plain text. Rows that repeat are
counted as often as they occur; null ids stay null; an empty table stays empty; other columns are left out; of pairs that are equally frequent all are the best.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize
from quire.llm.packing import ranked

#: Bytes of text that are aligned (or of pairs that are looked up) at once, a longer text being alone, and distinct parts tokenized in one call.
SLICE_BYTES, CALL_PARTS = 1 << 20, 512
#: Pairs whose counts every executor holds (16 bytes each), and pairs that a task gathers before it passes them on.
MOST_PAIRS, GATHERED = 1 << 20, 1 << 20
#: Counts of pairs that are passed on in one batch.
PASSED = 1 << 16
#: How pieces write a blank.
MARK = "▁"
#: A blank next to another one, at an end of the text, or next to a mark.
_ODD = rf" [\s\x0b\x1c-\x1f\x85\p{{Z}}]|{MARK}|^[\s\x0b\x1c-\x1f\x85\p{{Z}}]| $"

#: A text (pairs: its distinct pairs, times: how often each links, a byte a pair), or a pair with its count in a partition.
SHAPE = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary, pair long, n long"
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Files(NamedTuple):
    """Places of the tokenizers: A as JSON, and as ranks with their word pattern if there are; B's model."""

    a_json: str
    a_ranks: str | None
    a_pattern: str | None
    b_model: str


def public_files() -> Files:
    import public_tokenizers as public

    return Files(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model"))


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level_tokens(json_path: str) -> list[bytes]:
    with open(json_path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["id"]: t["content"].encode() for t in file.get("added_tokens", ())}
    known = {i: t for t, i in file["model"]["vocab"].items()}
    letters = byte_alphabet()
    return [special.get(i) or bytes(letters[c] for c in known.get(i, "")) for i in range(max([*known, *special]) + 1)]


def piece_tokens(model) -> list[bytes]:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    as_byte = re.compile("<0x([0-9A-F]{2})>")
    return [bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]


def link_kind(pairs: int) -> str:
    """How links are stored: in four bytes, if so many pairs can be told apart by them."""
    return "<u4" if pairs <= 1 << 32 else "<i8"


class Pair:
    """Both tokenizers, with the bytes of their ids."""

    def __init__(self, files: Files):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b_model)
        if files.a_ranks:  # special tokens are unknown to ranks, so their strings are plain text
            self.a = ranked(files.a_ranks, files.a_pattern).encode_ordinary
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(files.a_json)
            slow.encode_special_tokens = True
            self.a = lambda t: slow.encode(t, add_special_tokens=False).ids
        self.bytes = byte_level_tokens(files.a_json), piece_tokens(self.b)
        self.lengths = tuple(np.array([len(t) for t in tokens], dtype=np.int64) for tokens in self.bytes)
        n, m = map(len, self.bytes)
        self.b_ids, self.link_kind = m, link_kind(n * m)
        # what follows an id: one of its own kind in its group, the other kind or the next group
        self.words = np.array([*(f"{i}," for i in range(max(n, m))), *(f"{i}|" for i in range(n))], dtype=object), n
        self.ends = np.array([*(f"{i}," for i in range(m)), *(f"{i};" for i in range(m))], dtype=object)
        self.parts = not any(MARK in p.lstrip(MARK) for p in map(self.b.id_to_piece, range(m)))

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a(" " + t) for t in texts], self.b.encode(texts, num_threads=1)

    def same(self, ids: list[int], side: int, data: bytes) -> bool:
        return b"".join(map(self.bytes[side].__getitem__, ids)) == data


class Aligned(NamedTuple):
    """Figures of distinct parts; links of all parts one after another."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    text: list[str]
    links: np.ndarray
    link_ends: np.ndarray


def aligned(pair: Pair, parts: list[str], regular: int) -> Aligned:
    """Align parts; the first `regular` ones may be tokenized together, joined by blanks."""
    data = [b" " + p.encode("utf-8", "surrogatepass") for p in parts]
    ok = np.ones(len(parts), bool)
    ids: list[list[list[int]]] = [[], []]  # by side: runs of ids, in order
    alone = [*range(regular, len(parts))]
    together = [" ".join(parts[k : min(k + CALL_PARTS, regular)]) for k in range(0, regular, CALL_PARTS)]
    runs = pair.tokens(together) if together else ([], [])
    for k, (a, b) in enumerate(zip(*runs, strict=True)):
        own = range(k * CALL_PARTS, min((k + 1) * CALL_PARTS, regular))
        whole = b"".join(data[i] for i in own)
        if pair.same(a, 0, whole) and pair.same(b, 1, whole):
            ids[0].append(a)
            ids[1].append(b)
        else:  # some part differs: each by itself, in its place
            for i in own:
                _alone(pair, parts[i], data, ok, ids, i)
    for i in alone:
        _alone(pair, parts[i], data, ok, ids, i)
    a, b = (np.fromiter((i for run in side for i in run), np.int64) for side in ids)
    sizes = np.array([len(d) if o else 0 for d, o in zip(data, ok, strict=True)], dtype=np.int64)
    offsets = np.cumsum(sizes)
    total = int(offsets[-1]) if len(offsets) else 0
    ends_a, ends_b = np.cumsum(pair.lengths[0][a]), np.cumsum(pair.lengths[1][b])
    in_a, in_b = np.bincount(ends_a, minlength=total + 1), np.bincount(ends_b, minlength=total + 1)
    at = np.flatnonzero(in_a + in_b)
    in_a, in_b = in_a[at], in_b[at]
    cuts = in_a & in_b
    sum_a, sum_b, sum_cuts = (np.concatenate([[0], np.cumsum(x)]) for x in (in_a, in_b, cuts))
    links = a[sum_a[:-1]] * pair.b_ids + b[sum_b[:-1]] if len(at) else np.zeros(0, np.int64)
    place = np.searchsorted(at, offsets, side="right")  # merged ends up to the end of each part
    if total and not cuts[place[ok] - 1].all():
        raise ValueError("a part ends inside a token")
    of = lambda sums: np.diff(np.concatenate([[0], sums[place]]))
    return Aligned(ok, of(sum_a), of(sum_b), of(sum_cuts), _strings(pair, a, b, in_a, in_b, cuts, sum_cuts, sum_a[place], sum_b[place]), links, place)


def _alone(pair: Pair, part: str, data: list[bytes], ok: np.ndarray, ids: list, i: int) -> None:
    (a,), (b,) = pair.tokens([part])
    ok[i] = pair.same(a, 0, data[i]) and pair.same(b, 1, data[i])
    if ok[i]:
        ids[0].append(a)
        ids[1].append(b)


def _strings(pair: Pair, a, b, in_a, in_b, cuts, sum_cuts, upto_a, upto_b) -> list[str]:
    """The groups of each part as text: ids of A, a bar, ids of B, a semicolon between groups."""
    at_a, at_b = np.flatnonzero(in_a), np.flatnonzero(in_b)
    group_a, group_b = sum_cuts[at_a], sum_cuts[at_b]  # rising
    pieces = np.empty(len(a) + len(b), dtype=object)
    # A's last id of a group is the one before the group's cut, as B's is
    last_a = np.concatenate([group_a[1:] != group_a[:-1], [True]]) if len(a) else np.zeros(0, bool)
    last_b = np.concatenate([group_b[1:] != group_b[:-1], [True]]) if len(b) else np.zeros(0, bool)
    words, n = pair.words
    bars = len(words) - n
    pieces[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = words[np.where(last_a, a + bars, a)]
    pieces[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = pair.ends[np.where(last_b, b + pair.b_ids, b)]
    listed, ends = pieces.tolist(), (upto_a + upto_b).tolist()
    return ["".join(listed[s:e])[:-1] for s, e in zip([0, *ends], ends, strict=False)]


def parted(pair: Pair, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """Distinct parts of texts (null or empty: none): the number of each text's parts in order, their ends by text, the parts, and how many of these are regular."""
    filled = pc.fill_null(texts, "")
    empty = pc.equal(filled, "")
    odd = pc.and_(pc.invert(empty), pc.match_substring_regex(filled, _ODD)) if pair.parts else pc.invert(empty)
    cut = pc.split_pattern(pc.if_else(odd, "", filled), " ")
    flat = pc.list_flatten(cut).dictionary_encode()
    index, known = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), flat.dictionary.to_pylist()
    # texts that are null, empty or odd came out as one empty part each
    lengths = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    odd_at, empty_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)), empty.to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    if len(odd_at):
        own = filled.take(pa.array(odd_at)).dictionary_encode()
        index[starts[odd_at]] = len(known) + own.indices.to_numpy(zero_copy_only=False)
        known, regular = known + own.dictionary.to_pylist(), len(known)
    else:
        regular = len(known)
    keep = np.repeat(~empty_at, lengths)
    index, lengths = index[keep], np.where(empty_at, 0, lengths)
    used = np.zeros(len(known), bool)  # the empty part of what is not parted goes
    used[index] = True
    renumber = np.cumsum(used) - 1
    return renumber[index].astype(np.int32), np.cumsum(lengths), [k for k, u in zip(known, used.tolist(), strict=True) if u], int(used[:regular].sum())


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about SLICE_BYTES of a column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def tallied(index: np.ndarray, ends: np.ndarray, links: np.ndarray, link_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links of all texts, rising; then the distinct links of each text as places among them, how often each occurs there, and their ends by text.

    A text's parts are told apart first, so that the links of a part that repeats in it are taken once.
    """
    part, times, upto = _grouped(index, None, ends, len(link_ends))
    found, place = np.unique(links, return_inverse=True)
    own = np.diff(np.concatenate([[0], link_ends]))[part]  # links of each part of each text
    run_ends = np.cumsum(own)
    at = np.arange(run_ends[-1] if len(own) else 0) + np.repeat(link_ends[part] - run_ends, own)
    return found, *_grouped(place[at], np.repeat(times, own), np.concatenate([[0], run_ends])[upto], len(found))


def _grouped(values: np.ndarray, times: np.ndarray | None, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values (below most) of each run that ends at ends, their times (None: one each) summed, and the ends of the runs that are left."""
    keys = np.repeat(np.arange(len(ends)) * most, np.diff(np.concatenate([[0], ends])))
    keys += values
    if times is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    if times is None:
        sums = np.diff(np.concatenate([starts, [len(keys)]]))
    else:
        sums = np.add.reduceat(times, starts) if len(starts) else np.zeros(0, np.int64)
    keys = keys[starts]
    return keys % max(most, 1), sums, np.searchsorted(keys, np.arange(1, len(ends) + 1) * most, "left")


def in_bytes(values: np.ndarray, times: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with times of at most a byte: one that occurs more often is repeated, and the times of its copies add up."""
    copies = (times + 254) // 255
    last = np.cumsum(copies)
    small = np.full(last[-1] if len(last) else 0, 255, np.uint8)
    small[last - 1] = times - 255 * (copies - 1)
    return np.repeat(values, copies), small, np.concatenate([[0], last])[ends]


def cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary cell for each run of values."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def in_cells(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binary cells one after another, and their ends by cell."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.slice(offsets[0], offsets[-1] - offsets[0]) if data else b"", kind), (offsets[1:] - offsets[0]) // size


def _rows(names: list[str], columns: dict[str, pa.Array], kinds: dict[str, pa.DataType], n: int) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in names], names=names)


def _first(files: Files):
    """A row per text: figures that need no counts, and its pairs. A row per pair: its count, summed over slices before it is passed on."""
    kinds = {n: {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for n, k in (f.split() for f in SHAPE.split(", "))}
    names = list(kinds)

    def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), PASSED):
            own = keys[k : k + PASSED]
            yield _rows(names, {"pair": pa.array(own), "n": pa.array(counts[k : k + PASSED])}, kinds, len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(files)
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for run_ in slices(batch):
                index, ends, parts, regular = parted(pair, run_.column(1))
                done = aligned(pair, parts, regular)
                whole = segment_sums((~done.ok[index]).astype(np.int64), ends) == 0
                lists = index.tolist()
                shas = [
                    hashlib.sha256(";".join(map(done.text.__getitem__, lists[s:e])).encode()).hexdigest() if e > s and w else ""
                    for s, e, w in zip([0, *ends[:-1].tolist()], ends.tolist(), whole.tolist(), strict=True)
                ] if len(ends) else []
                del lists
                sums = [np.where(whole, segment_sums(x[index], ends), 0) for x in (done.n_a, done.n_b, done.n_groups)]
                sizes = np.diff(np.concatenate([[0], ends]))
                found, place, times, upto = tallied(index[np.repeat(whole, sizes)], np.cumsum(np.where(whole, sizes, 0)), done.links, done.link_ends)
                stored, small, stored_ends = in_bytes(found[place].astype(pair.link_kind), times, upto)
                yield _rows(names, {
                    "doc_id": run_.column(0), **{n: pa.array(x, pa.int64()) for n, x in zip(("n_a", "n_b", "n_groups"), sums, strict=True)},
                    "groups_sha256": pa.array(shas, pa.string()), "pairs": cells(stored, stored_ends), "times": cells(small, stored_ends),
                }, kinds, run_.num_rows)
                counts = np.zeros(len(found), np.int64)
                np.add.at(counts, place, times)
                linked = counts > 0  # links of parts that occur in no whole text do not count
                new = found[linked], counts[linked]
                held = _merged([held[0], new[0]], [held[1], new[1]]) if held else new
                if len(held[0]) > GATHERED:
                    yield from out(*held)
                    held = None
        if held:
            yield from out(*held)

    return run


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end at ends, by running sums."""
    return np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(values)])[ends]])) if len(ends) else np.zeros(0, np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, place, np.concatenate(counts))
    return found, out


def _second(pairs, best, b_ids: int, kind: str):
    """A row per text with its figures, and the pairs whose counts are not among the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, counts), most = pairs.value, best.value
        for batch in batches:
            for run_ in slices(batch, batch.schema.names.index("pairs")):
                cols = dict(zip(run_.schema.names, run_.columns, strict=True))
                (links, ends), (times, _) = in_cells(cols["pairs"], kind), in_cells(cols["times"], "u1")
                links, times = links.astype(np.int64), times.astype(np.int64)
                at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
                known = keys[at] == links if len(keys) else np.zeros(len(links), bool)
                n = np.where(known, counts[at], 0) if len(keys) else np.zeros(len(links), np.int64)
                is_best = known & (n == most[links % b_ids])
                count_sum, n_best, unknown = (segment_sums(x, ends) for x in (n * times, is_best * times, (~known).astype(np.int64)))
                rest = pa.StructArray.from_arrays([pa.array(links[~known]), pa.array(times[~known])], names=["pair", "times"])
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(unknown)]), pa.int32()), rest)
                n_links = pc.subtract(pc.add(cols["n_a"], cols["n_b"]), cols["n_groups"])
                yield pa.RecordBatch.from_arrays([
                    *(cols[c] for c in ("doc_id", "n_a", "n_b", "n_groups")), n_links, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), cols["groups_sha256"], rest,
                ], names=["doc_id", *FIGURES, "groups_sha256", "rest"])

    return run


def align(docs: DataFrame, files: Files, text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, FIGURES, groups_sha256) of every row of docs; doc_id is a whole number."""
    spark = docs.sparkSession
    pair = Pair(files)  # only for its numbers of ids
    b_ids, kind = pair.b_ids, pair.link_kind
    sent = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").alias("text"))
    first = materialize(sent.mapInArrow(_first(files), SHAPE))
    counted = materialize(first.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")))
    best = counted.groupBy((F.col("pair") % b_ids).cast("int").alias("b")).agg(F.max("n").alias("most"))
    most = np.zeros(b_ids, np.int64)
    for r in best.collect():  # a row per id of B
        most[r["b"]] = r["most"]
    # the least power of two that leaves few enough pairs
    sizes = dict(counted.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect())
    least, total = 64, 0
    while least and total + sizes.get(least - 1, 0) <= most_pairs:
        least -= 1
        total += sizes.get(least, 0)
    frequent = counted.where(F.col("n") >= F.shiftleft(F.lit(1).cast("long"), min(least, 62))).toArrow()
    keys, counts = frequent["pair"].to_numpy(), frequent["n"].to_numpy()
    order = np.argsort(keys)
    context = spark.sparkContext
    lookup, greatest = context.broadcast((keys[order], counts[order])), context.broadcast(most)
    shape = "doc_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", groups_sha256 string, rest array<struct<pair: long, times: long>>"
    figured = first.where(F.col("pair").isNull()).select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times").mapInArrow(
        _second(lookup, greatest, b_ids, kind), shape)
    if not any(n for size, n in sizes.items() if size < least):
        return figured.select("doc_id", *FIGURES, "groups_sha256")
    figured = materialize(figured.withColumn("row", F.monotonically_increasing_id()))
    rare = counted.where(F.col("n") < F.shiftleft(F.lit(1).cast("long"), min(least, 62))).join(
        F.broadcast(best), F.col("b") == F.col("pair") % b_ids).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    added = figured.select("row", F.inline("rest")).join(rare, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.col("is_best") * F.col("times")).alias("_best"))
    return figured.join(added, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
