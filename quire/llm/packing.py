"""Best-fit packing with swap-based local search.

Documents become token ids plus an end id; only those longer than a sequence are cut, into
full pieces of which the first may be shorter. Pieces are packed by length: pieces of
one length are interchangeable, so the bins are kept as classes, a multiset of lengths with the
number of bins that hold it. There are at most `capacity` lengths, so the histogram
and the classes stay small whatever the number of documents, and the packing is global.

Best fit places lengths in falling order, each into the fullest bin that takes it. Then local search works on
the underfull bins: moves of one piece, exchanges one for one and two for one, each of which
must raise the sum of squared fills; bins that run empty are dropped. It ends when no exchange from an emptier bin into
one at least as full helps, or when the bins are as few as the total length allows. Partners are found in an index
by length and room, so the search has no other bound.

Pieces are numbered by (length, doc_id, piece, checksum) through ranges and a written table; a piece's
number and the classes decide its sequence and offset, looked up by binary search. The lookup
table has a row per class and length and is bounded by the capacity, not by the documents.

Defined cases: a null or empty text is one piece with the end id only; repeated rows are packed as
often as they occur; null ids come first; an empty table gives an empty result; a text that
holds the end marker's string is tokenized as the tokenizer file says.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import global_index, materialize

CAPACITY = 2048
END_ID = 0


def ranked(path: str, pattern: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Byte-level BPE ids of a tokenizer file. A rank file of the same vocabulary makes it five times as fast.

    Both give the same ids (tests compare them), except for strings of special tokens, which only the first knows; texts
    that hold one go to it.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer as Slow

        self.slow = Slow.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = ranked(ranks_path, pattern) if ranks_path else None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def public_tokenizer() -> tuple[str, str, str]:
    """Places of the 50k byte-level BPE files and the pattern of their words."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(df: DataFrame, tokenizer: tuple[str, str | None, str | None], capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        of = Tokenizer(*tokenizer).ids
        for pdf in batches:
            rows = []
            for doc_id, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = np.array([*of(t), END_ID] if isinstance(t, str) else [END_ID], dtype="<u4").tobytes()
                for k, (start, n) in enumerate(cut(len(data) // 4, capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": pdf["doc_id"].dtype})

    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    # doc ids travel as text, so that nulls do not turn numbers into floats
    sent = df.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return sent.mapInPandas(run, shape.replace(f"doc_id {kind}", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast(kind))


Bin = tuple[tuple[int, int], ...]  # (length, count) pairs from long to short


def fill(b: Bin) -> int:
    return sum(n * c for n, c in b)


def changed(b: Bin, out: tuple[int, ...] = (), into: tuple[int, ...] = ()) -> Bin:
    c = Counter(dict(b))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((n, k) for n, k in c.items() if k), reverse=True))


def best_fit(lengths: dict[int, int], capacity: int) -> Counter[Bin]:
    """Best fit in falling order over a histogram; equal bins are handled together."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        rooms = sorted(r for r in by_room if r >= n and by_room[r])
        while left:
            if rooms:
                room = rooms[0]
                b, many = next(iter(by_room[room].items()))
            else:
                room, b, many = capacity, (), left
            each = min(room // n, left)
            used = min(many, left // each)
            if room < capacity:
                by_room[room][b] -= used
                if not by_room[room][b]:
                    del by_room[room][b]
                if not by_room[room]:
                    rooms.pop(0)
            by_room[room - each * n][changed(b, (), (n,) * each)] += used
            left -= used * each
    return Counter({b: m for bins in by_room.values() for b, m in bins.items() if m})


class Search:
    """Bins under improvement, indexed by what they can give back and how much room they have.

    For every length y, rooms[y] is a bit set of the rooms of underfull classes that hold a piece of y (y = 0: of all),
    and held[y, room] lists those classes. A take of t pieces' length from bin a for y out of bin b raises the
    squared fill by d = t - y if b is at least as full as a, and fits if d is at most b's room.
    """

    def __init__(self, bins: Counter[Bin], capacity: int):
        self.bins = Counter(bins)
        self.capacity = capacity
        self.total = sum(bins.values())
        self.rooms: dict[int, int] = defaultdict(int)
        self.held: dict[tuple[int, int], dict[Bin, None]] = defaultdict(dict)
        for b in sorted(self.bins):
            self.listed(b)

    def listed(self, b: Bin) -> None:
        room = self.capacity - fill(b)
        if room:
            for y in (0, *(n for n, _ in b)):
                self.held[y, room][b] = None
                self.rooms[y] |= 1 << room

    def unlisted(self, b: Bin) -> None:
        room = self.capacity - fill(b)
        if room:
            for y in (0, *(n for n, _ in b)):
                held = self.held[y, room]
                del held[b]
                if not held:
                    del self.held[y, room]
                    self.rooms[y] &= ~(1 << room)

    def add(self, b: Bin, times: int) -> None:
        if b and times:
            if not self.bins[b]:
                self.listed(b)
            self.bins[b] += times

    def remove(self, b: Bin, times: int) -> None:
        self.bins[b] -= times
        if not self.bins[b]:
            del self.bins[b]
            self.unlisted(b)

    def best(self, a: Bin) -> tuple[tuple[int, ...], int, int] | None:
        """What to take out of a, what it gets back (0: nothing), and the room of a bin to deal with: the largest gain."""
        takes = {n: (n,) for n, _ in a}
        for i, (m, c) in enumerate(a):
            for n, _ in a[i if c > 1 else i + 1 :]:
                takes.setdefault(m + n, (m, n))
        most = max(takes)
        room = self.capacity - fill(a)
        limit = (1 << (room + 1)) - 1  # bins at least as full as a
        reach, backs, top = [], [], -1
        for y in sorted(y for y in self.rooms if y < most):
            got = y + (self.rooms[y] & limit).bit_length() - 1
            if got > max(top, y):  # what a smaller piece reaches is better had for that one
                top = got
                reach.append(got)
                backs.append(y)
        found, gain = None, 0
        for t, take in takes.items():
            k = bisect_left(reach, t)
            if k < len(reach) and t - backs[k] > gain and not (len(take) > 1 and not backs[k]):
                found, gain = (take, backs[k], t - backs[k]), t - backs[k]
        return found

    def improve(self, a: Bin) -> tuple[Bin, int] | None:
        """Carry out the largest gain that a can give; what became of a, and of how many of its bins."""
        alone = self.bins[a] == 1
        if alone:
            self.unlisted(a)  # a bin does not deal with itself
        found = self.best(a)
        if alone:
            self.listed(a)
        if found is None:
            return None
        take, y, d = found
        fits = self.rooms[y] >> d
        room = d + (fits & -fits).bit_length() - 1  # of the fullest bin that takes it
        b = next(x for x in self.held[y, room] if not (alone and x == a))
        back = (y,) if y else ()
        times = self.bins[a] // 2 if a == b else min(self.bins[a], self.bins[b])
        new_a, new_b = changed(a, take, back), changed(b, back, take)
        self.remove(a, times)
        self.remove(b, times)
        self.add(new_b, times)
        self.add(new_a, times)
        self.total -= 0 if new_a else times
        return new_a, times

    def run(self, target: int) -> None:
        """Passes over the bins from the emptiest until a whole pass finds nothing or only target bins are left."""
        moved = True
        while moved and self.total > target:
            moved = False
            for a in sorted((b for b in self.bins if fill(b) < self.capacity), key=lambda b: (fill(b), b)):
                while a and self.bins[a] and self.total > target:
                    step = self.improve(a)
                    if step is None:
                        break
                    moved = True
                    if not self.bins[a]:
                        a = step[0]


def local_search(bins: Counter[Bin], capacity: int, target: int) -> Counter[Bin]:
    """Raise the sum of squared fills until no exchange from an emptier bin into a fuller one helps, or target bins are left.

    Each step takes one or two pieces out of a bin and gives none or one back, where the other bin is at least as
    full. Every state is a whole packing, and the sum of squares rises with each step, so it ends.
    """
    search = Search(bins, capacity)
    search.run(target)
    return +search.bins


class Places(NamedTuple):
    """Rows sorted by the first piece number they cover: how to turn a number into a place."""

    first: np.ndarray  # first piece number
    each: np.ndarray  # pieces of this length in one bin
    sequence: np.ndarray  # id of the first bin
    offset: np.ndarray  # place of the first of them in the bin
    length: np.ndarray


def places(lengths: dict[int, int], bins: Counter[Bin]) -> Places:
    """Deal the numbered pieces of every length (numbers rise with length) over the classes."""
    start, at = {}, 0
    for n in sorted(lengths):
        start[n] = at
        at += lengths[n]
    rows, sequence = [], 0
    for b in sorted(bins):
        offset = 0
        for n, c in b:
            rows.append((start[n], c, sequence, offset, n))
            start[n] += c * bins[b]
            offset += n * c
        sequence += bins[b]
    rows.sort()
    return Places(*(np.array([r[k] for r in rows], dtype=np.int64) for k in range(5)))


def pack_lengths(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter[Bin]:
    """Bins for a histogram of lengths, each at most capacity."""
    total = sum(n * c for n, c in lengths.items())
    return local_search(best_fit(lengths, capacity), capacity, -(-total // capacity))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32)."""
    order = [F.col(c).asc_nulls_first() for c in ("length", "doc_id", "piece", "ids_crc32")]
    numbered, total = global_index(pieces, order, "_number")
    lengths = {r[0]: r[1] for r in numbered.groupBy("length").count().collect()}
    table = places(lengths, pack_lengths(lengths, capacity))

    def place(numbers: pd.Series) -> pd.DataFrame:
        x = numbers.to_numpy()
        k = np.searchsorted(table.first, x, side="right") - 1
        nth = x - table.first[k]
        return pd.DataFrame({
            "sequence_id": table.sequence[k] + nth // table.each[k],
            "offset": table.offset[k] + nth % table.each[k] * table.length[k],
        })

    placed = numbered.withColumn("_at", F.pandas_udf(place, "sequence_id long, offset long")("_number"))
    return placed.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: tuple[str, str | None, str | None] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there."""
    pieces = materialize(token_pieces(docs, tokenizer or public_tokenizer(), capacity))  # ranges are sampled: tokenize once
    return pack_pieces(pieces, capacity)
