"""Conversation structure repair: the cheapest edits that make roles follow one another, by a tensor of state costs.

The rows of a conversation stand by turn (nulls first, then by role, then by a hash of the text; rows that are equal in all
are interchangeable). A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (its last character
other than white space ends no sentence). Edits are Keep (free, 3 if truncated), Rerole to user or assistant (3, and 3 if truncated), Delete (4, the
only one for blank and duplicate rows) and Insert of an empty turn (3). The edits of least cost are taken whose result is
empty or an optional system turn before pairs of user and assistant; of several, those whose initials sort first.

What has been kept is one of four states: nothing, system, user, assistant. Conversations are put in buckets by length; in a bucket
all conversations' costs from here to the end are worked out turn by turn, last turn first, as one array (conversation, state) per turn; these are
stored, and edits are traced from the first turn on, again for all conversations at once.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks. Those that lie inside
one range are repaired in that task. A conversation at the edge of a range may go on in the next; such ones are cut in slices, one per
range. A slice gives the costs from each state to each state (the same recursion with four ends); chaining these small tables backwards gives every slice
its costs at the end, and a trace from each state gives where it leaves off; so slices are repaired in parallel and exactly. Only
these tables come to the driver, at most two slices a range beside those of conversations that fill ranges. The checksum of a conversation's text has
to read it in order: it is streamed, so memory stays bounded.

Defined cases: null role, text, conversation and turn are one space where they are read as text; a null conversation is one of its own, and
null turns come first and count in no gap; an empty table stays empty; a conversation without rows has zeros, no edits and the checksum of
nothing; other columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BLANKS, materialize

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the only turn that may be inserted, or that a row may become.
FORCED = np.array([USER, USER, ASSISTANT, USER])
#: (role, state): the state after a kept row, -1 if it may not stand there. Roles: system, user, assistant, other.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: More than any cost.
NEVER = 1 << 50
#: A conversation may end with nothing or after an assistant.
END = np.array([0, NEVER, NEVER, 0])
#: Faults, and the code of a place behind a conversation's last row.
SOUND, CUT, BLANK, DUPLICATE = range(4)
PAD = 16
NAMES = {USER: "user", ASSISTANT: "assistant"}
ROLE_OF = {"s": 0, "u": 1, "a": 2}
#: Rows of a bucket that are worked on at once.
CELLS = 1 << 16

RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "part int, seq long, turn string, role string, text string, gone boolean"


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs if turns may be inserted first; more than two never pay."""
    one = INSERT + costs[..., FORCED]
    return np.minimum(np.minimum(costs, one), INSERT + one[..., FORCED])


def options(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of Delete, Keep and Rerole for each (conversation, state), given those after the row."""
    role, fault = codes % 4, codes // 4
    late = np.where(fault == CUT, TRUNCATED, 0)[:, None]
    stays = (fault < BLANK)[:, None]
    to = KEPT[role]
    keep = np.where(stays & (to >= 0), np.take_along_axis(after, np.maximum(to, 0), 1) + late, NEVER)
    rerole = np.where(stays, after[:, FORCED] + REROLE + late, NEVER)
    return after + DELETE, keep, rerole


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turn, conversation, state): the least cost from before this turn to the end. codes: (turn, conversation)."""
    out = np.empty((len(codes) + 1, codes.shape[1], 4), np.int64)
    out[-1] = closed(end)
    for t in range(len(codes) - 1, -1, -1):
        delete, keep, rerole = options(np.minimum(codes[t], PAD - 1), out[t + 1])
        costs = np.minimum(closed(np.minimum(np.minimum(delete, keep), rerole)), NEVER)
        out[t] = np.where((codes[t] == PAD)[:, None], out[t + 1], costs)
    return out


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edits of least cost whose initials sort first.

    Returns (conversation, turn and end, three places: two inserts and the row's edit): the initials, and the roles
    given (0: none), and the states at the end. last: whether the conversation ends here, so that turns may be inserted behind its last row.
    """
    turns, many = codes.shape
    initials, roles = (np.zeros((many, turns + 1, 3), np.uint8) for _ in range(2))
    lane, state = np.arange(many), state.copy()
    lengths = (codes != PAD).sum(0)
    for t in range(turns + 1):
        here = t < lengths
        for place in range(3):
            now = costs[t, lane, state]
            if t < turns:
                delete, keep, rerole = (x[lane, state] for x in options(np.minimum(codes[t], PAD - 1), costs[t + 1]))
                delete_now = here & (delete == now) & (initials[:, t, 2] == 0)
            else:
                delete_now = np.zeros(many, bool)
            settled = initials[:, t, 2] != 0
            insert = (INSERT + costs[t, lane, FORCED[state]] == now) & ~settled & ~delete_now
            insert &= here | ((t == lengths) & last & (END[state] > 0))
            if delete_now.any():
                initials[delete_now, t, 2] = ord("D")
            if t < turns:
                kept = here & ~settled & ~delete_now & ~insert
                keeps = kept & (keep == now)
                changes = kept & ~keeps
                initials[keeps, t, 2], initials[changes, t, 2] = ord("K"), ord("R")
                roles[changes, t, 2] = FORCED[state[changes]]
                state[keeps] = KEPT[codes[t, keeps] % 4, state[keeps]]
                state[changes] = FORCED[state[changes]]
            if not insert.any():
                break
            initials[insert, t, place], roles[insert, t, place] = ord("I"), FORCED[state[insert]]
            state[insert] = FORCED[state[insert]]
    return initials, roles, state


def buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of conversations of like length, few enough to be worked on at once."""
    kind = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        each = max(1, CELLS >> int(k))
        yield from (own[i : i + each] for i in range(0, len(own), each))


def stacked(codes: list[np.ndarray]) -> np.ndarray:
    """(turn, conversation), filled behind the last rows."""
    out = np.full((max(map(len, codes), default=0), len(codes)), PAD, np.int64)
    for c, own in enumerate(codes):
        out[: len(own), c] = own
    return out


def fault_codes(roles: list[str], texts: list[str], seen: set, known: list[bool] | None = None) -> np.ndarray:
    """role + 4 * fault of each row; seen gathers the rows so far, known marks rows that were seen in an earlier slice."""
    out = np.empty(len(roles), np.int64)
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        body = text.rstrip(BLANKS)
        row = (role, text)
        fault = BLANK if not body else DUPLICATE if row in seen or (known and known[k]) else SOUND if body[-1] in ".!?" else CUT
        seen.add(row)
        out[k] = ROLE_OF.get(role[:1], 3) + 4 * fault
    return out


def figures(codes: np.ndarray, turns: list[int | None], initials: list[str]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated, illegal."""
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    fault = codes // 4
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return gaps, int((fault == BLANK).sum()), int((fault == DUPLICATE).sum()), int((fault == CUT).sum()), illegal


def written(initials: np.ndarray, given: np.ndarray, roles: list[str], texts: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """The edits of one conversation, and its repaired rows."""
    rows = []
    for t in range(min(len(roles) + 1, len(initials))):
        for place in range(3):
            edit = initials[t, place]
            if edit == ord("I"):
                rows.append((NAMES[given[t, place]], ""))
            elif edit == ord("R"):
                rows.append((NAMES[given[t, place]], texts[t]))
            elif edit == ord("K"):
                rows.append((roles[t], texts[t]))
    flat = initials[: len(roles) + 1].ravel()
    return flat[flat != 0].tobytes().decode(), rows


class Conversation:
    """Rows of one conversation in order; rows that are gone only name it."""

    def __init__(self, conv: str | None):
        self.conv, self.turns, self.roles, self.texts = conv, [], [], []

    def add(self, turn: str | None, role: str, text: str) -> None:
        self.turns.append(None if turn is None else int(turn))
        self.roles.append(role)
        self.texts.append(text)


def repaired(group: list[Conversation]) -> Iterator[tuple[Conversation, tuple, int, str, list[tuple[str, str]]]]:
    """Each conversation with its figures, cost, edits and repaired rows."""
    codes = [fault_codes(c.roles, c.texts, set()) for c in group]
    for own in buckets(np.array([len(c) for c in codes], dtype=np.int64)) if group else ():
        block = stacked([codes[i] for i in own])
        ends = np.broadcast_to(END, (len(own), 4))
        costs = backward(block, ends)
        initials, given, _ = trace(block, costs, np.zeros(len(own), np.int64), np.ones(len(own), bool))
        for c, i in enumerate(own.tolist()):
            item = group[i]
            audit, rows = written(initials[c], given[c], item.roles, item.texts)
            yield item, figures(codes[i], item.turns, [r[:1] for r in item.roles]), int(costs[0, c, NOTHING]), audit, rows


def digest(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "surrogatepass")).hexdigest()


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repairs what lies inside a range; rows of its first and its last conversation go on as they are."""
    names = ["conv", *(f.split()[0] for f in RESULT.split(", ")[1:]), *(f.split()[0] for f in OPEN.split(", "))]
    first, held, seq, begun = True, [], 0, False
    conv, many = None, 0

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in (*names[1:7], "part", "seq")} | {"gone": "boolean"})

    def raw(item: Conversation, rows: list[tuple]) -> list[tuple]:
        return [(item.conv, *[None] * 8, *r) for r in rows]

    done: list[Conversation] = []
    for pdf in batches:
        out = []
        for part, key, turn, role, text, gone in zip(*(pdf[c] for c in ("part", "conv", "turn", "role", "text", "gone")), strict=True):
            key = None if pd.isna(key) else key
            turn = None if pd.isna(turn) else turn
            if not begun or key != conv:
                if begun and not first:
                    done.append(now)
                first, begun, conv, held = not begun, True, key, []
                now = Conversation(key)
            row = (part, seq, turn, role, text, bool(gone))
            seq += 1
            if first:
                out += raw(now, [row])
            else:
                held.append(row)
                if not gone:
                    now.add(turn, role, text)
        many += len(pdf)
        for item, facts, cost, audit, rows in repaired(done):
            out.append((item.conv, *facts, cost, audit, digest(rows), *[None] * 6))
        done = []
        if out:
            yield frame(out)
    if held and not first:
        yield frame(raw(now, held))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Conversation, list, list]]:
    """(conversation, part) slices of a sorted stream: key, rows, marks of rows seen in earlier slices, places."""
    key, now, known, seqs = None, None, [], []
    for pdf in batches:
        for conv, part, seq, turn, role, text, gone, again in zip(*(pdf[c] for c in ("conv", "part", "seq", "turn", "role", "text", "gone", "again")), strict=True):
            here = (None if pd.isna(conv) else conv, int(part))
            if here != key:
                if now is not None:
                    yield key, now, known, seqs
                key, now, known, seqs = here, Conversation(here[0]), [], []
            if not gone:
                now.add(None if pd.isna(turn) else turn, role, text)
                known.append(bool(again))
                seqs.append(int(seq))
    if now is not None:
        yield key, now, known, seqs


SLICE = "conv string, part int, codes binary, tables array<long>, turns array<long>, distinct long, initials string, blank long, duplicate long, truncated long, illegal long"


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per slice: its codes, its costs from each state to each state, its figures."""
    names = [f.split()[0] for f in SLICE.split(", ")]
    for (conv, part), item, known, _ in _slices(batches):
        codes = fault_codes(item.roles, item.texts, set(), known)
        ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
        out = np.full((4, 4), NEVER, np.int64)
        if len(codes):
            block = np.repeat(codes[:, None], 4, axis=1)
            after = np.empty((4, 4), np.int64)
            after[:] = ends
            for t in range(len(codes) - 1, -1, -1):  # inserts stand before rows, so none are made at the end of a slice
                delete, keep, rerole = options(block[t], after)
                after = np.minimum(closed(np.minimum(np.minimum(delete, keep), rerole)), NEVER)
            out = after.T
        else:
            out = ends.T.copy()
        starts = [r[:1] for r in item.roles]
        known_turns = [t for t in item.turns if t is not None]
        _, blank, duplicate, truncated, illegal = figures(codes, [], starts)
        yield pd.DataFrame([(conv, part, codes.astype(np.uint8).tobytes(), out.ravel().tolist(), [min(known_turns), max(known_turns)] if known_turns else [],
                             len(set(known_turns)), (starts[0] + "\0" + starts[-1]) if starts else None, blank, duplicate, truncated, illegal)], columns=names)


def _leaves(ends: dict):
    """Where a trace from each state leaves a slice; ends: costs behind each slice, and whether it is the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv, part, codes in zip(pdf["conv"], pdf["part"], pdf["codes"], strict=True):
                conv = None if pd.isna(conv) else conv
                end, last = ends[conv, int(part)]
                block = np.repeat(np.frombuffer(codes, np.uint8).astype(np.int64)[:, None], 4, axis=1)
                costs = backward(block, np.broadcast_to(np.array(end), (4, 4)))
                _, _, state = trace(block, costs, np.arange(4), np.full(4, last))
                rows.append((conv, int(part), state.tolist(), costs[0, 0].tolist()))
            yield pd.DataFrame(rows, columns=["conv", "part", "leaves", "costs"])

    return run


def _traced(ends: dict, begins: dict):
    """Repaired rows and edits of slices, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv, part), item, known, seqs in _slices(batches):
            end, last = ends[conv, part]
            codes = fault_codes(item.roles, item.texts, set(), known)[:, None]
            costs = backward(codes, np.array([end]))
            initials, given, _ = trace(codes, costs, np.array([begins[conv, part]]), np.array([last]))
            rows = []
            for t in range(len(item.roles) + 1):
                own = t < len(item.roles)
                audit, made = written(initials[0][t : t + 1], given[0][t : t + 1], item.roles[t : t + 1] if own else [], item.texts[t : t + 1] if own else [])
                if audit:
                    rows.append((conv, part, seqs[t] if own else NEVER, audit, "".join(f"\n{r}:{x}" for r, x in made)))
            yield pd.DataFrame(rows, columns=["conv", "part", "seq", "audit", "made"])

    return run


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits and checksum of each conversation, of rows in order."""
    key, audit, sha, begun, fresh = None, [], None, False, True

    def row() -> pd.DataFrame:
        return pd.DataFrame([(key, "".join(audit), sha.hexdigest())], columns=["conv", "audit", "repaired_sha256"])

    for pdf in batches:
        for conv, a, made in zip(pdf["conv"], pdf["audit"], pdf["made"], strict=True):
            conv = None if pd.isna(conv) else conv
            if not begun or conv != key:
                if begun:
                    yield row()
                key, audit, sha, begun, fresh = conv, [], hashlib.sha256(), True, True
            audit.append(a)
            if made:
                sha.update((made[1:] if fresh else made).encode("utf-8", "surrogatepass"))
                fresh = False
    if begun:
        yield row()


def _chained(slices: list) -> tuple[dict, dict]:
    """Costs behind each slice (and whether it is the last), and conversations' slices in order."""
    by_conv: dict = {}
    for s in sorted(slices, key=lambda s: s["part"]):
        by_conv.setdefault(s["conv"], []).append(s)
    ends = {}
    for conv, own in by_conv.items():
        costs = np.array(END)
        for k, s in enumerate(reversed(own)):
            ends[conv, s["part"]] = (costs.tolist(), k == 0)
            at_end = closed(costs) if k == 0 else costs
            table = np.array(s["tables"]).reshape(4, 4)
            costs = closed(np.minimum((table + at_end[None, :]).min(1), NEVER))
    return ends, by_conv


def _summed(by_conv: dict, costs: dict) -> list[tuple]:
    """Figures of the conversations that are cut in slices."""
    out = []
    for conv, own in by_conv.items():
        turns = [t for s in own for t in s["turns"]]
        distinct, before, illegal, initial = 0, None, sum(s["illegal"] for s in own), None
        for s in own:
            if s["turns"]:
                distinct += s["distinct"] - (before == s["turns"][0])  # turns rise, so slices share one at most
                before = s["turns"][1]
            if s["initials"] is not None:
                first, last = s["initials"].split("\0")
                if initial is not None and initial + first not in ("su", "ua", "au"):
                    illegal += 1
                initial = last
        gaps = max(turns) - min(turns) + 1 - distinct if turns else 0
        out.append((conv, gaps, *(sum(s[k] for s in own) for k in ("blank", "duplicate", "truncated")), illegal, costs[conv]))
    return out


def _spread(spread: DataFrame) -> DataFrame:
    """The result for conversations at the edges of ranges, slice by slice."""
    spark = spread.sparkSession
    mark = F.sha2(F.col("text").cast("binary"), 256)
    firsts = spread.where("not gone").groupBy("conv", "part", "role", mark.alias("mark")).agg(F.min("seq").alias("seq"))
    firsts = materialize(firsts)
    earliest = firsts.groupBy("conv", "role", "mark").agg(F.min("part").alias("first_part"))
    again = firsts.alias("f").join(
        earliest.alias("e"), F.col("f.conv").eqNullSafe(F.col("e.conv")) & (F.col("f.role") == F.col("e.role")) & (F.col("f.mark") == F.col("e.mark"))
    ).where("f.part > e.first_part").select(F.col("f.part").alias("_part"), F.col("f.seq").alias("_seq"))
    marked = materialize(spread.join(again, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq")), "left").select(
        "conv", "part", "seq", "turn", "role", "text", "gone", F.col("_seq").isNotNull().alias("again")))
    dealt = marked.repartition("conv", "part").sortWithinPartitions("conv", "part", "seq")
    tables = materialize(dealt.mapInPandas(_tables, SLICE))
    slices = [r.asDict() for r in tables.drop("codes").collect()]  # two a range beside those of conversations that fill ranges
    ends, by_conv = _chained(slices)
    leaves = {(r["conv"], r["part"]): r for r in tables.select("conv", "part", "codes").mapInPandas(
        _leaves(ends), "conv string, part int, leaves array<int>, costs array<long>").collect()}
    begins, costs = {}, {}
    for conv, own in by_conv.items():
        state = NOTHING
        costs[conv] = leaves[conv, own[0]["part"]]["costs"][NOTHING]
        for s in own:
            begins[conv, s["part"]] = state
            state = leaves[conv, s["part"]]["leaves"][state]
    edits = dealt.mapInPandas(_traced(ends, begins), "conv string, part int, seq long, audit string, made string")
    text = edits.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInPandas(_hashed, "conv string, audit string, repaired_sha256 string")
    figured = spark.createDataFrame(_summed(by_conv, costs), ", ".join(RESULT.split(", ")[:7]).replace("conv ", "_conv "))
    return figured.join(text, F.col("_conv").eqNullSafe(F.col("conv")), "left").select(
        F.col("_conv").alias("conv"), *[F.col(f.split()[0]) for f in RESULT.split(", ")[1:7]],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repair(df: DataFrame, gone: Column | None = None) -> DataFrame:
    """A row per conversation of df (conv_id, turn, role, text): its faults, the edits, their cost and the checksum of the result.

    Rows for which gone holds are not part of their conversation, which is returned all the same.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    hidden = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = df.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), hidden.alias("gone"),
    ).withColumn("text", F.when(F.col("gone"), F.lit("")).otherwise(F.col("text"))).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.xxhash64("text").asc(), F.col("_row").asc()]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "gone")
    first = materialize(sorted_rows.mapInPandas(_inside, f"{RESULT}, {OPEN}"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    whole = first.where("part IS NULL").select(*names).unionByName(_spread(first.where("part IS NOT NULL")))
    return whole.select(F.col("conv").cast(kind).alias("conv_id"), *names[1:])


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; gone marks the rows that are dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"),
                                (kind == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")
