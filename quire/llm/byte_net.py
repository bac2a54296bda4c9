"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by WIDTH - 1, so that every WIDTH bytes of the whole
text lie in one chunk. FILTERS learned filters over learned byte vectors run over every chunk; each filter's greatest
response in a chunk (max-pooling) is cut off below zero. Over the chunks of a text the greatest and the mean response of every filter
are kept, and a logistic layer makes one probability of them.

Filters see a byte vector and, as a second input, a mark where the MEMORY bytes that end there have occurred shortly before:
repetition is no pattern of bytes that a filter could learn by itself.

A response is a sum of WIDTH table rows, one for each byte of the window, as vectors and filters are multiplied out before:
scoring has neither a copy of windows nor a product per byte. Memory is bounded by BLOCK bytes, however long the text.

Training: at most MAX_EACH labelled documents of each kind, those with the smallest hash of their id, of at most MAX_BYTES.
Both kinds weigh as they occur. Backpropagation passes the maxima only. The start is fixed, so runs agree.

Defined cases: a null or empty text is one chunk without bytes and has a score; labels of null or unknown documents
are left out; without documents of both kinds every score is 0.5; repeated rows score alike; other columns are
kept, and one named score is replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import labelled_texts

#: Bounds of the training sample: documents of each kind, and bytes of one document.
MAX_EACH, MAX_BYTES = 1500, 8192
#: Bytes that a filter sees; bytes of a chunk; filters; length of a byte's vector.
WIDTH, CHUNK, FILTERS, VECTOR = 7, 134, 16, 8
#: Window starts of a chunk, and window starts that are worked on at once.
STEP, BLOCK = CHUNK - WIDTH + 1, 1 << 15
#: Bytes that have to occur again for a mark, and how far back that may be.
MEMORY, LAGS = 5, (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
#: The byte that fills chunks; UTF-8 never has it.
NOTHING = 255
EPOCHS, STEPS, BATCH, RATE = 14, 800, 32, 0.01


class Net(NamedTuple):
    vectors: np.ndarray  # (512, VECTOR): by byte, and by byte with a mark
    filters: np.ndarray  # (WIDTH, VECTOR, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS + 1,)

    def tables(self) -> np.ndarray:
        """(WIDTH, 512, FILTERS): what a symbol adds to each filter at each place of the window."""
        return np.einsum("sv,wvf->wsf", self.vectors, self.filters).astype(np.float32)


class Layout(NamedTuple):
    symbols: np.ndarray  # all texts one after another, each filled up to whole chunks
    chunks: np.ndarray  # chunks of each text


def symbols_of(data: np.ndarray) -> np.ndarray:
    """Bytes, 256 more where the MEMORY bytes that end there have occurred at one of LAGS before."""
    out = data.astype(np.uint16)
    marked = np.zeros(len(data), bool)
    for lag in LAGS:
        if len(data) >= lag + MEMORY:
            same = np.cumsum(np.concatenate([[0], data[lag:] == data[:-lag]]), dtype=np.int32)
            marked[lag + MEMORY - 1 :] |= same[MEMORY:] - same[:-MEMORY] == MEMORY
    out[marked & (data != NOTHING)] += 256
    return out


def laid(texts: list[bytes]) -> Layout:
    """Texts filled to chunks, with so many empty places after each that no window and no lag reaches from one into the next."""
    chunks = np.array([-(-(len(t) + max(WIDTH - 1, LAGS[-1])) // STEP) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(t + b"\xff" * (int(n) * STEP - len(t)) for t, n in zip(texts, chunks, strict=True)), np.uint8)
    return Layout(symbols_of(data), chunks)


def responses(tables: np.ndarray, layout: Layout, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(chunk, filter): the greatest response, and where in the chunk it is."""
    x = np.concatenate([layout.symbols, np.full(WIDTH - 1, NOTHING, np.uint16)]).astype(np.intp)
    n = len(layout.symbols) // STEP
    best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
    each = max(1, BLOCK // STEP)
    ends = np.zeros(n, bool)
    ends[np.cumsum(layout.chunks) - 1] = True  # the last WIDTH - 1 windows of a text would reach into the next
    out, row = np.empty((each * STEP, FILTERS), np.float32), np.empty((each * STEP, FILTERS), np.float32)
    for k in range(0, n, each):
        m = min(each, n - k)
        total, add = out[: m * STEP], row[: m * STEP]
        np.take(tables[0], x[k * STEP : (k + m) * STEP], axis=0, out=total, mode="clip")
        for w in range(1, WIDTH):
            np.take(tables[w], x[k * STEP + w : (k + m) * STEP + w], axis=0, out=add, mode="clip")
            total += add
        by_chunk = total.reshape(m, STEP, FILTERS)
        by_chunk[ends[k : k + m], STEP - WIDTH + 1 :] = -np.inf
        by_chunk.max(axis=1, out=best[k : k + m])
        if places:
            where[k : k + m] = by_chunk.argmax(axis=1)
    return best, where


def pooled(best: np.ndarray, bias: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text (greatest and mean cut-off response, constant), and the cut-off responses by chunk."""
    positive = np.maximum(best + bias, 0).astype(np.float64)
    starts = np.cumsum(chunks) - chunks
    most = np.maximum.reduceat(positive, starts)
    mean = np.add.reduceat(positive, starts) / chunks[:, None]
    return np.hstack([most, mean, np.ones((len(chunks), 1))]), positive


def scores(net: Net, tables: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The probability of each text, whole."""
    out = []
    for group in grouped(texts):
        layout = laid(group)
        features, _ = pooled(responses(tables, layout)[0], net.bias, layout.chunks)
        out.append(1 / (1 + np.exp(-np.clip(features @ net.weights, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def grouped(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about `most` bytes; a longer text is alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def start(seed: int = 1) -> Net:
    rng = np.random.default_rng(seed)
    return Net(
        rng.normal(0, 0.5, (512, VECTOR)), rng.normal(0, (2 / (WIDTH * VECTOR)) ** 0.5, (WIDTH, VECTOR, FILTERS)),
        np.zeros(FILTERS), np.concatenate([rng.normal(0, 0.1, 2 * FILTERS), [0.0]]),
    )


def gradient(net: Net, layout: Layout, labels: np.ndarray) -> Net:
    """Of the mean logistic loss over some texts."""
    best, where = responses(net.tables(), layout, places=True)
    features, positive = pooled(best, net.bias, layout.chunks)
    p = 1 / (1 + np.exp(-np.clip(features @ net.weights, -500, 500)))
    error = (p - labels) / len(labels)
    back = error[:, None] * net.weights[None, : 2 * FILTERS]
    text = np.repeat(np.arange(len(layout.chunks)), layout.chunks)
    is_most = (positive == features[text, :FILTERS]) & (positive > 0)
    starts = np.cumsum(layout.chunks) - layout.chunks
    ties = np.maximum(np.add.reduceat(is_most, starts, dtype=np.int64), 1)
    on = back[text, FILTERS:] / layout.chunks[text][:, None] + is_most * back[text, :FILTERS] / ties[text]
    on = np.where(positive > 0, on, 0.0)
    x = np.concatenate([layout.symbols, np.full(WIDTH - 1, NOTHING, np.uint16)]).astype(np.int64)
    at = np.arange(len(best))[:, None] * STEP + where
    lane = np.arange(FILTERS)[None, :]
    by_symbol = np.stack([
        np.bincount((x[at + w] * FILTERS + lane).ravel(), on.ravel(), 512 * FILTERS).reshape(512, FILTERS) for w in range(WIDTH)
    ])
    return Net(
        np.einsum("wsf,wvf->sv", by_symbol, net.filters), np.einsum("wsf,sv->wvf", by_symbol, net.vectors), on.sum(0), features.T @ error,
    )


def fit(good: list[bytes], bad: list[bytes], epochs: int = EPOCHS, decay: float = 1e-4) -> Net:
    """Adam on batches of texts in a fixed order, for at least STEPS batches; the rate falls to zero."""
    texts, labels = good + bad, np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    epochs = max(epochs, -(-STEPS * BATCH // len(texts)))
    rng, net = np.random.default_rng(2), start()
    mean, square = ([np.zeros_like(p) for p in net] for _ in range(2))
    steps, done = epochs * -(-len(texts) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            slope = gradient(net, laid([texts[i] for i in pick]), labels[pick])
            done += 1
            rate = RATE * (1 - done / (steps + 1))
            fresh = []
            for j, (p, g) in enumerate(zip(net, slope, strict=True)):
                g = g + decay * p
                mean[j] += 0.1 * (g - mean[j])
                square[j] += 0.01 * (g * g - square[j])
                fresh.append(p - rate * (mean[j] / (1 - 0.9**done)) / (np.sqrt(square[j] / (1 - 0.99**done)) + 1e-8))
            net = Net(*fresh)
    return net


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def train(docs: DataFrame, labels: DataFrame) -> Net | None:
    """A net from the labelled documents that are not held out; none without both kinds."""
    good, bad = labelled_texts(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label")), MAX_EACH, MAX_EACH, MAX_BYTES)
    return fit([as_bytes(t) for t in good], [as_bytes(t) for t in bad]) if good and bad else None


def with_score(df: DataFrame, net: Net | None, text: str = "text") -> DataFrame:
    """Add score, the probability that a text is of good quality."""
    if net is None:
        return df.withColumn("score", F.lit(0.5))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = net.tables()
        for texts in batches:
            yield pd.Series(scores(net, tables, [as_bytes(t) for t in texts]))

    return df.withColumn("score", F.pandas_udf(run, "double")(F.col(f"`{text}`")))
