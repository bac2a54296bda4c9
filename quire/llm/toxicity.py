"""Toxicity by compression distance with two zstandard dictionaries.

zstandard's trainer makes one dictionary from ordinary texts and one from toxic texts. A text is cut into overlapping windows
of 64 bytes; each is compressed with the ordinary dictionary and with both together, and the bytes that the toxic one saves are
compared with thresholds, calibrated on ordinary documents. A logistic model turns counts of windows over the
thresholds into a score.

Trained on whole texts both dictionaries hold the same frequent stretches, so the toxic one's samples are chosen by compression itself. Toxic texts
are halved; windows of one half that the other half's raw text shortens more than as much ordinary text does are the first samples. A dictionary trained on one half's
samples then chooses those of the other half. The trainer's last dictionary is cut into pieces, and each piece is measured: in how many toxic
and in how many ordinary documents does it, beside the ordinary dictionary, shorten a window? Pieces are kept one by one, the most telling first, for what
those before them leave; and the documents that no piece tells go through the same again. From the second round on the ordinary documents are those
that raw toxic text shortens most, so that no piece tells a language or a manner of writing instead. A text's windows are all compressed, by both.

Dictionaries are loaded as content (the trainer's tables, which stand before it, are left out), since zstandard loads one trained dictionary at a time. Every window starts with a mark that
both end with: without a first match zstandard stores short windows raw, and no length would differ.

Training: at most MAX_TOXIC and MAX_ORDINARY labelled documents of at most MAX_BYTES, those with the smallest
hash of their id. Thresholds and the logistic model are fitted on folds that their
dictionaries did not see, and the score is shifted so that 0.5 is where F1 is greatest on them at
no more than MOST_FALSE false alarms: toxic documents are few, so even odds would overlook too many. Scoring covers every document and the whole text.

Defined cases: a null or empty text has no windows and gets the score of no evidence; labels of null or
of unknown documents are left out; without documents of both kinds every score is 0; where the trainer has too little
text, the samples themselves are the dictionary; repeated rows score alike; other columns are kept, and one named
score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, labelled_texts

#: Bounds of the training sample: documents of each kind, and bytes of one document.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 600, 3000, 16384
#: Bytes of the toxic dictionary at most, of the trainer's dictionaries, and of the segments that the trainer picks.
TOXIC_BYTES, CANDIDATE_BYTES, ORDINARY_BYTES = 768, 2048, 16384
TOXIC_SEGMENT, ORDINARY_SEGMENT = 12, 32
#: Bytes of a window, and of its overlap with the next one.
WINDOW, OVERLAP = 64, 12
#: The same for windows that may become samples; raw text that chooses them; share of ordinary windows that shorten less.
SAMPLE, SAMPLE_STEP, RAW_BYTES, RARE = 32, 16, 131072, 0.99
#: Pieces of the trainer's dictionary, how much one has to tell at most (see telling), and rounds over documents not told yet.
PIECE, PIECE_STEP, TELLS, ROUNDS = 10, 5, 20.0, 3
FOLDS = 3
#: The share of ordinary documents of the folds that may score 0.5 or more.
MOST_FALSE = 0.015
#: Shares of ordinary windows below the thresholds.
LEVELS = (0.99, 0.998, 0.9995)
MARK = b"~this~mark~opens~each~window~of~text~"

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PUNCTUATION = str.maketrans(dict.fromkeys(".,;:!?\"()[]{}", " "))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").translate(_PUNCTUATION).encode("utf-8", "surrogatepass").translate(_LOWER).split()


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" " if words else b""


def starts(length: int) -> range:
    """Where the windows of a joined text begin; the last one may be shorter."""
    return range(0, max(1, length - OVERLAP), WINDOW - OVERLAP) if length else range(0)


def content(trained: bytes, samples: list[bytes]) -> bytes:
    """What a trained dictionary holds behind its tables: it begins with the first eight bytes that some sample has."""
    whole = b"\n".join(samples)
    for at in range(8, len(trained) - 8):
        if trained[at : at + 8] in whole:
            return trained[at:]
    return trained


def trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """The content of the dictionary that zstandard's trainer makes of the samples."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return content(zstandard.train_dictionary(size, samples, k=segment, d=6, steps=1, threads=0, level=6).as_bytes(), samples)
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[-size:]


class Lengths:
    """Compressed lengths of windows with a dictionary's content."""

    def __init__(self, held: bytes):
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=16, search_log=5, min_match=4, target_length=32,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        data = zstandard.ZstdCompressionDict(held + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        self.compress = zstandard.ZstdCompressor(compression_params=params, dict_data=data).compress

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        compress = self.compress
        return np.fromiter((len(compress(MARK + w)) for w in windows), np.int64, len(windows))


def windows_of(text: bytes) -> list[bytes]:
    return [text[k : k + WINDOW] for k in starts(len(text))]


def samples_of(text: bytes) -> list[bytes]:
    return [text[k : k + SAMPLE] for k in range(0, max(1, len(text) - SAMPLE // 2), SAMPLE_STEP)]


def alike(toxic: list[bytes], ordinary: list[bytes], known: bytes) -> list[bytes]:
    """Ordinary texts in the language and manner of the toxic ones: twice as many, those that raw toxic text shortens most."""
    usual, near = (Lengths(b"".join(texts)[:RAW_BYTES] + known) for texts in (ordinary, toxic))
    gains = []
    for k, text in enumerate(ordinary):
        windows = windows_of(text)
        gains.append(((usual(windows) - near(windows)).mean() if windows else -np.inf, -k))
    return [ordinary[-k] for _, k in sorted(gains, reverse=True)[: 2 * len(toxic)]]


def candidates(toxic: list[bytes], check: list[bytes], known: bytes) -> bytes:
    """A dictionary trained on windows of toxic texts that other toxic texts shorten, and as much of the ordinary ones does not."""
    halves = [[w for t in toxic[h::2] for w in samples_of(t)] for h in (0, 1)]
    control = [w for t in check[::2] for w in samples_of(t)]
    usual = Lengths(b"".join(check[1::2])[:RAW_BYTES] + known)
    plain = Lengths(known)
    by_half, by_control = [plain(h) for h in halves], plain(control)
    chosen: list[list[bytes]] = []
    for k in range(3):
        new = []
        for h in (0, 1):
            if k:
                other = Lengths(trained(CANDIDATE_BYTES, chosen[1 - h], TOXIC_SEGMENT) + known)
                gain, chance = by_half[h] - other(halves[h]), by_control - other(control)
            else:
                other = Lengths(b"".join(toxic[1 - h :: 2])[:RAW_BYTES] + known)
                gain, chance = usual(halves[h]) - other(halves[h]), usual(control) - other(control)
            least = max(np.quantile(chance, RARE), 0) if len(chance) else 0
            new.append([w for w, g in zip(halves[h], gain, strict=True) if g > least])
        chosen = new
    return trained(CANDIDATE_BYTES, chosen[0] + chosen[1], TOXIC_SEGMENT)


def telling(toxic: int, ordinary: int, base: float) -> float:
    """How far the documents in which a piece saves bytes are from the usual mix: their number times the divergence of the shares."""
    n = toxic + ordinary
    share = toxic / n if n else 0.0
    if share <= base:
        return 0.0
    return n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0))


def shortened(texts: list[bytes], plain: Lengths, both: Lengths) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Windows that the second dictionary shortens, with their texts' numbers and their lengths by the first."""
    windows = [w for t in texts for w in windows_of(t)]
    owner = np.repeat(np.arange(len(texts)), [len(starts(len(t))) for t in texts])
    usual = plain(windows)
    at = np.flatnonzero(both(windows) < usual)
    return [windows[k] for k in at], owner[at], usual[at]


def pieces(toxic: list[bytes], check: list[bytes], known: bytes, tells: float) -> list[bytes]:
    """Pieces of the candidates that shorten toxic documents rather than ordinary ones, the most telling first."""
    found = candidates(toxic, check, known)
    plain, both = Lengths(known), Lengths(found + known)
    sides = [shortened(texts, plain, both) for texts in (toxic, check)]
    base = len(toxic) / (len(toxic) + len(check))
    left = [np.ones(len(s[0]), bool) for s in sides]

    def worth(hits: list[np.ndarray]) -> float:
        return telling(*(len(np.unique(owner[h & free])) for h, free, (_, owner, _) in zip(hits, left, sides, strict=True)), base)

    open_pieces = []
    for piece in sorted({found[k : k + PIECE] for k in range(0, len(found) - PIECE + 1, PIECE_STEP)}):
        lengths = Lengths(piece + known)
        hits = [usual > lengths(windows) for windows, _, usual in sides]
        if worth(hits) >= tells:
            open_pieces.append((piece, hits))
    kept = []
    while open_pieces:
        worths = [worth(hits) for _, hits in open_pieces]
        best = max(range(len(worths)), key=worths.__getitem__)
        if worths[best] < tells:
            break
        piece, hits = open_pieces[best]
        kept.append(piece)
        for free, h in zip(left, hits, strict=True):
            free &= ~h
        open_pieces = [p for k, p in enumerate(open_pieces) if k != best and worths[k] >= tells]
    return kept


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of both dictionaries."""
    t, o = ([joined(words_of(x)) for x in texts] for texts in (toxic, ordinary))
    known = trained(ORDINARY_BYTES, [x[k : k + WINDOW] for x in o for k in range(0, len(x), WINDOW)], ORDINARY_SEGMENT)
    kept: list[bytes] = []
    tells = min(TELLS, 8 + len(t) / 18)  # few documents can tell little
    for k in range(ROUNDS):
        if len(t) < 4 or len(kept) * PIECE >= TOXIC_BYTES:
            break
        held = b"".join(kept[::-1]) + known
        new = pieces(t, alike(t, o, held) if k else o[: 2 * len(t)], held, tells)
        if not new:
            break
        kept += new
        saved = Distance(b"".join(kept[::-1]), known)
        t = [x for x in t if not (saved(x) > 0).any()]
    return b"".join(kept[: TOXIC_BYTES // PIECE][::-1]), known


class Distance:
    """Bytes that the toxic dictionary saves on the windows of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.usual, self.both = Lengths(ordinary), Lengths(toxic + ordinary)

    def __call__(self, text: bytes) -> np.ndarray:
        """The savings, window by window."""
        windows = windows_of(text)
        return self.usual(windows) - self.both(windows)


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    thresholds: np.ndarray  # by level
    weights: np.ndarray

    def evidence(self, saved: np.ndarray) -> np.ndarray:
        if not len(saved):
            return np.zeros(2 * len(LEVELS) + 3)
        hits = (saved[None, :] > self.thresholds[:, None]).sum(1)
        excess = np.maximum(saved - self.thresholds[0], 0).sum()
        return np.concatenate([np.log1p(hits), 5 * hits / len(saved), [np.log1p(len(saved)), min(excess, 30) / 10, min(saved.max(), 12) / 4]])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(evidence)), evidence] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return b


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from all texts; thresholds and weights from folds that their dictionaries did not see."""
    parts = []
    for k in range(FOLDS):
        saved = Distance(*train_dictionaries(
            [t for i, t in enumerate(toxic) if i % FOLDS != k], [t for i, t in enumerate(ordinary) if i % FOLDS != k]
        ))
        for label, texts in ((1, toxic), (0, ordinary)):
            parts += [(label, saved(joined(words_of(t)))) for t in texts[k::FOLDS]]
    clean = np.concatenate([p[1] for p in parts if not p[0]])
    thresholds = np.maximum(np.quantile(clean, LEVELS), 0) if len(clean) else np.full(len(LEVELS), 3.0)
    model = Model(*train_dictionaries(toxic, ordinary), thresholds, np.zeros(0))
    x = np.array([model.evidence(saved) for _, saved in parts])
    y = np.array([float(p[0]) for p in parts])
    weights = logistic(x, y)
    weights[0] -= best_cut(np.c_[np.ones(len(x)), x] @ weights, y)
    return model._replace(weights=weights)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is greatest on the folds among cuts of at most MOST_FALSE alarms, half way to the next lower value."""
    order = np.argsort(-z, kind="stable")
    hits, at = np.cumsum(y[order]), np.arange(1, len(z) + 1)
    last = np.append(z[order][1:] < z[order][:-1], True)  # equal values stay together
    allowed = last & (at - hits <= MOST_FALSE * (len(y) - y.sum()))
    if not allowed.any():
        return float(z[order][0])
    best = int(np.argmax(np.where(allowed, 2 * hits / (at + y.sum()), -1)))
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    return float((z[order][best] + below) / 2)


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """The bounded sample, toxic and ordinary."""
    return labelled_texts(docs, labels.select("doc_id", F.col("toxic").alias("label")), MAX_TOXIC, MAX_ORDINARY, MAX_BYTES)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    toxic, ordinary = training_texts(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return fit(toxic, ordinary) if len(toxic) >= FOLDS and len(ordinary) >= FOLDS else None


def with_score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score, the probability that a text is toxic."""
    if model is None:
        return df.withColumn("score", F.lit(0.0))

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        saved = Distance(model.toxic, model.ordinary)
        for texts in batches:
            rows = [model.evidence(saved(joined(words_of(t)))) for t in texts]
            yield pd.Series(model.score(np.array(rows)) if rows else np.zeros(0))

    return df.withColumn("score", F.pandas_udf(scores, "double")(F.col(f"`{text}`")))
