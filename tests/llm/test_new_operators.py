"""The byte net, conversation repair and tokenizer alignment against plain second versions, on whole tables and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import align, byte_net, dialogue, queries
from tests.helpers import DATA

# ---- byte net

def test_quality_held_out(spark):
    scored = queries.op11_quality_net(spark, "/root/testdata/sf0.01")
    assert scored.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(r.predicted for r in bad) <= 0.2 * len(bad)
    assert all(0 <= r.score <= 1 for r in rows)


def plain_score(net, text):
    """The definition, window by window."""
    data = np.frombuffer(text, np.uint8)
    chunks = -(-(len(data) + max(byte_net.WIDTH - 1, byte_net.LAGS[-1])) // byte_net.STEP)
    filled = np.concatenate([data, np.full(chunks * byte_net.STEP + byte_net.WIDTH, 255, np.uint8)])
    marked = [
        b != 255 and any(k - lag - byte_net.MEMORY + 1 >= 0 and bytes(filled[k - byte_net.MEMORY + 1 : k + 1]) == bytes(filled[k - lag - byte_net.MEMORY + 1 : k - lag + 1])
                         for lag in byte_net.LAGS)
        for k, b in enumerate(filled)
    ]
    vectors = net.vectors[filled.astype(int) + 256 * np.array(marked)]
    best = np.full((chunks, byte_net.FILTERS), -np.inf)
    for c in range(chunks):
        for k in range(c * byte_net.STEP, (c + 1) * byte_net.STEP):
            if k <= chunks * byte_net.STEP - byte_net.WIDTH:
                best[c] = np.maximum(best[c], np.einsum("wv,wvf->f", vectors[k : k + byte_net.WIDTH], net.filters))
    positive = np.maximum(best + net.bias, 0)
    z = np.concatenate([positive.max(0), positive.mean(0), [1]]) @ net.weights
    return 1 / (1 + np.exp(-z))


def test_net_by_definition():
    net = byte_net.start(3)._replace(bias=np.linspace(-0.5, 0.5, byte_net.FILTERS))
    rng = random.Random(1)
    texts = [b"", b"a", b"over over over over", "größe".encode() * 30] + [bytes(rng.choices(b"ab c.\n", k=n)) for n in (127, 128, 129, 700)]
    got = byte_net.scores(net, net.tables(), texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)
    assert np.allclose(got, [byte_net.scores(net, net.tables(), [t])[0] for t in texts], atol=1e-6)  # neighbours don't matter


def test_gradient_is_the_slope():
    rng = np.random.default_rng(5)
    net = byte_net.start(4)._replace(bias=rng.normal(0, 0.1, byte_net.FILTERS))
    texts, labels = [b"some words here", b"## $$ ##", b"plain text again " * 12], np.array([1.0, 0.0, 1.0])

    def loss(n):
        p = byte_net.scores(n, n.tables(), texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    slope = byte_net.gradient(net, byte_net.laid(texts), labels)
    for k in range(4):
        direction = rng.normal(size=net[k].shape)
        step = 1e-3
        up, down = (net._replace(**{net._fields[k]: net[k] + s * direction}) for s in (step, -step))
        assert abs((loss(up) - loss(down)) / (2 * step) - (slope[k] * direction).sum()) < 2e-2


def test_net_edges(spark):
    kind = "doc_id long, text string, score string, pattern string"
    docs = spark.createDataFrame([(1, None, "x", "y"), (1, "", "x", "y"), (None, "word " * 9000, "x", "y"), (None, "word " * 9000, "x", "y")], kind)
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 0)], "doc_id long, quality int")
    assert byte_net.train(docs, labels) is None
    assert {r.score for r in byte_net.with_score(docs, None).collect()} == {0.5}
    rows = byte_net.with_score(docs, byte_net.start()).collect()
    assert len(rows) == 4 and {r.pattern for r in rows} == {"y"}
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert byte_net.with_score(docs.limit(0), byte_net.start()).count() == 0


# ---- conversation repair

def cheapest(rows):
    """(cost, edits, repaired rows) by search over all edits: Dijkstra by cost, then by edits."""
    import heapq

    seen, faults = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, k, roles, out = heapq.heappop(heap)
        state = roles[-1:] if len(roles) > 1 or roles[-1:] != "s" else "s"
        if (k, state) in done:
            continue
        done[k, state] = 1
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "su"[:0] + roles):
            return cost, audit, out, faults
        need = "a" if roles[-1:] == "u" else "u"
        name = {"u": "user", "a": "assistant"}[need]
        steps = [("I", 3, k, need, ((name, ""),))]
        if k < len(rows):
            role, text = rows[k]
            steps.append(("D", 4, k + 1, "", ()))
            if faults[k] in ("", "cut"):
                late = 3 * (faults[k] == "cut")
                if role[:1] == need or (role[:1] == "s" and not roles):
                    steps.append(("K", late, k + 1, role[:1], ((role, text),)))
                steps.append(("R", 3 + late, k + 1, need, ((name, text),)))
        for edit, more, to, new, made in steps:
            if len(audit) < 3 * len(rows) + 4:
                heapq.heappush(heap, (cost + more, audit + edit, to, roles + new, out + made))
    raise AssertionError


def plain_repair(rows):
    """rows: (turn, role, text, gone) of one conversation."""
    here = [r for r in rows if not r[3]]
    here.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    cost, audit, out, faults = cheapest([(r[1], r[2]) for r in here])
    turns = {r[0] for r in here if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(here)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("cut"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def plain_damage(rows):
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", said[3]) if kind == 2 else said[3]
        by_conv[conv] += [(turn, "user" if kind == 4 else said[2], text, kind == 0)] * (1 + (kind == 3))
    return by_conv


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("sf_dir", [DATA, "/root/testdata/sf0.01"])
def test_op12(spark, sf_dir):
    got = {r.conv_id: tuple(r[c] for c in FIGURES) for r in queries.op12_repair(spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == {conv: plain_repair(rows) for conv, rows in plain_damage(table).items()}


def made_up(seed, many, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(many):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]) if seed % 2 else turn, role, rng.choice(["Yes.", "No", "", " ", f"Fine {turn}.", f"And {turn}", None])))
    return rows


@pytest.mark.parametrize("seed", [0, 2, 4])
def test_repair_against_search(spark, seed):
    rows = made_up(seed, 60, 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: tuple(r[c] for c in FIGURES) for r in dialogue.repair(df).collect()}
    want = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, " " if role is None else role, " " if text is None else text, False))
    assert got == {c: plain_repair(r) for c, r in want.items()}


def test_one_conversation_over_many_ranges(spark):
    """A conversation that holds nearly all rows is cut in slices; the result is that of the whole."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Line {t}.", f"Line {t}", "Again.", "", "Same"])) for t in range(1500) if t % 37]
    rows += [(c, t, ["user", "assistant"][t % 2], f"Turn {t}.") for c in (3, 9) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r[c] for c in FIGURES) for r in dialogue.repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for conv in (3, 7, 9):
        assert got[conv] == plain_repair([(t, r, x, False) for c, t, r, x in rows if c == conv])


def test_repair_edges(spark):
    kind = "conv_id long, turn long, role string, text string, cost string, part string"
    rows = [(None, None, "user", "Hi.", "x", "y"), (None, 1, "assistant", "Ho.", "x", "y"), (1, 1, None, None, "x", "y"), (2, 5, "user", "Only.", "x", "y"),
            (3, 1, "user", "Long " * 200_000 + ".", "x", "y"), (3, 2, "assistant", "Yes.", "x", "y"), (4, 1, "user", "Bye.", "x", "y")]
    df = spark.createDataFrame(rows, kind)
    got = {r.conv_id: r for r in dialogue.repair(df, F.col("conv_id") == 4).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (got[None].cost, got[None].audit) == (0, "KK")
    assert (got[1].cost, got[1].audit, got[1].blank, got[1].repaired_sha256) == (4, "D", 1, nothing)
    assert (got[2].cost, got[2].audit) == (3, "KI")
    assert (got[3].cost, got[3].audit) == (0, "KK")
    assert tuple(got[4][c] for c in FIGURES) == (0, 0, 0, 0, 0, 0, "", nothing)
    assert dialogue.repair(df.limit(0)).count() == 0


# ---- alignment

@pytest.fixture(scope="module")
def pair():
    return align.Pair(align.public_files())


def plain_alignment(texts):
    """Token by token, with the tokenizers that the contract names."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    letters, known = align.byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    rows, count = [], collections.Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        data = b" " + text.encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in known[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            rows.append(None)
            continue
        links, groups, i, j, end_a, end_b, own = [], [], 0, 0, len(bytes_a[0]), len(bytes_b[0]), ([ids_a[0]], [ids_b[0]])
        while True:
            links.append((ids_a[i], ids_b[j]))
            to_a, to_b = end_a <= end_b, end_b <= end_a
            if to_a and to_b:
                groups.append(own)
                own = ([], [])
            if to_a:
                i += 1
            if to_b:
                j += 1
            if i == len(ids_a):
                break
            if to_a:
                end_a += len(bytes_a[i])
                own[0].append(ids_a[i])
            if to_b:
                end_b += len(bytes_b[j])
                own[1].append(ids_b[j])
        rows.append((ids_a, ids_b, groups, links))
        count.update(links)
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, links = r
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


ODD = [None, "", " ", "  ", "\n", "a", "two  spaces", " lead", "trail ", "x▁y", "▁", "<|endoftext|> in text", "<s> </s> <unk>", "tab\t next", "line\n next\r\n end\n", "é ü 漢字 かな 😀",
       "a b  c", "nul\x00byte", "1234 56,7 don't we'll", "word " * 3000 + "end", "\x1c \x85 x", "one  two", "漢" * 5000, "same same same", "same same same"]


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r[c] for c in ("doc_id", *align.FIGURES, "groups_sha256")) for r in align.align(df, align.public_files(), **options).collect())
    assert got == sorted((k, *f) for (k, _), f in zip(rows, plain_alignment([t for _, t in rows]), strict=True))


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 20, 0])
def test_alignment_of_odd_texts(spark, most):
    compare(spark, list(enumerate(ODD)), most_pairs=most)


def test_op13(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", *align.FIGURES, "groups_sha256")) for r in queries.op13_alignment(spark, DATA).collect())
    assert got == sorted((k, *f) for (k, _), f in zip(rows, plain_alignment([t for _, t in rows]), strict=True))


def test_alignment_edges(spark):
    files = align.public_files()
    df = spark.createDataFrame([(None, "some text", "x"), (None, "some text", "x"), (1, None, "x")], "doc_id long, text string, n_a string")
    rows = align.align(df, files).collect()
    assert len(rows) == 3 and sum(r.doc_id is None for r in rows) == 2 and {r.n_a for r in rows} == {0, 2}
    assert align.align(df.limit(0), files).count() == 0


def test_alignment_stores_small_cells(spark, monkeypatch):
    """No stored cell holds more than one text asks for, however many texts are aligned at once."""
    written = []
    monkeypatch.setattr(align, "materialize", lambda df, keep=align.materialize: written.append(keep(df)) or written[-1])
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(3000)]
    rows = [(k, " ".join(rng.choices(words, k=20))) for k in range(4000)]
    compare(spark, rows)
    size = {c: F.length(F.to_json(F.struct(c))) for c in written[0].columns}  # bytes are in base64
    largest = written[0].agg(*[F.max(x).alias(c) for c, x in size.items()]).first().asDict()
    assert max(x or 0 for x in largest.values()) < 1000, largest


def test_links_of_texts(pair):
    """Pairs and times of texts against a count link by link: parts that repeat, texts without parts, times about a byte's bound."""
    rng = np.random.default_rng(7)
    for most in (1, 3, 40):
        sizes = rng.integers(0, 6, most)
        link_ends, links = np.cumsum(sizes), rng.integers(0, 9, sizes.sum()) * 100_000_007
        ends = np.cumsum(rng.integers(0, 700, 12) * rng.integers(0, 2, 12))
        index = rng.integers(0, most, ends[-1]).astype(np.int32)
        found, place, times, upto = align.tallied(index, ends, links, link_ends)
        stored, small, stored_ends = align.in_bytes(found[place], times, upto)
        (got, got_ends), (got_times, _) = align.in_cells(align.cells(stored, stored_ends), "<i8"), align.in_cells(align.cells(small, stored_ends), "u1")
        assert got_ends.tolist() == stored_ends.tolist()
        for s, e, p, q in zip([0, *ends[:-1]], ends, [0, *got_ends[:-1]], got_ends, strict=True):
            want = collections.Counter(int(x) for i in index[s:e] for x in links[link_ends[i] - sizes[i] : link_ends[i]])
            have = collections.Counter()
            for x, n in zip(got[p:q].tolist(), got_times[p:q].tolist(), strict=True):
                have[x] += n
            assert have == want
    for n in (1, 254, 255, 256, 509, 510, 511, 70_000):
        stored, small, stored_ends = align.in_bytes(np.array([4, 6]), np.array([n, 1]), np.array([0, 1, 2, 2]))
        assert small[stored == 4].astype(int).sum() == n and small[stored == 6].tolist() == [1] and small.min() > 0
        assert stored_ends.tolist() == [0, len(small) - 1, len(small), len(small)]
        cut = align.cells(small, stored_ends).slice(1)  # a cell column that does not begin at its buffer's start
        assert [x.tolist() for x in align.in_cells(cut, "u1")] == [small.tolist(), (stored_ends[1:]).tolist()]


def test_parts_are_tokenized_as_wholes(pair):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(["a", "Ba", "é", " ", " ", "\n", "7", ".", "漢", "\t", "'s", "--"], k=rng.randint(1, 60)))
        import pyarrow as pa

        index, ends, parts, regular = align.parted(pair, pa.array([text, "other words here"]))
        done = align.aligned(pair, parts, regular)
        own = index[: ends[0]]
        a, b = pair.tokens([text])
        assert done.n_a[own].sum() == len(a[0]) and done.n_b[own].sum() == len(b[0])
