"""Quality classifier: a byte-level convolutional network in numpy.

Each byte of a text, and a mark whether its 4 bytes occurred in the ``LAGS`` bytes before (so that
repetition is visible to filters of a few bytes), pass through learned filters of ``WIDTH`` bytes. Their
rectified outputs are averaged over chunks of ``CHUNK`` bytes that overlap by half and cover the
whole document; a second layer of learned filters reads each chunk, is max-pooled over all chunks,
and a logistic unit combines the maxima into one probability. Training is plain gradient descent
(Adam) with back-propagation through the winning chunks.

A byte filter is a table lookup for each tap, so scoring is a few gathers and adds a byte. Texts
are scored in blocks of ``BLOCK`` bytes with a carried overlap: memory does not follow a text's length.

Defined results: null and empty texts score as one chunk of padding; repeated rows score alike;
without labelled rows of both classes every score is the share of label 1 seen (1 if no row is
labelled). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, held_out, labelled_sample, text_of, through_python

WIDTH = 3
FILTERS = 12
HIDDEN = 16
CHUNK = 64
STEP = 32
LAGS = range(2, 25)
BLOCK = 1 << 16
#: Bound of the training sample: labelled documents of each class.
PER_CLASS = 500


def repeated(data: np.ndarray) -> np.ndarray:
    """1 where the 4 bytes that end here also ended ``LAGS`` bytes before."""
    out = np.zeros(len(data), dtype=bool)
    if len(data) > 5:
        four = data[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            four = (four << np.uint32(8)) | data[k : len(data) - 3 + k]
        for lag in LAGS:
            if lag < len(four):
                out[3 + lag :] |= four[lag:] == four[:-lag]
    return out


class Network:
    def __init__(self, seed: int = 3) -> None:
        random = np.random.default_rng(seed)
        self.taps = random.normal(0, 0.3, (WIDTH, 512, FILTERS)).astype(np.float32)
        self.first = np.zeros(FILTERS, dtype=np.float32)
        self.mix = random.normal(0, 0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.second = np.zeros(HIDDEN, dtype=np.float32)
        self.out = random.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.taps, self.first, self.mix, self.second, self.out, self.bias]

    @staticmethod
    def symbols(data: bytes, before: bytes = b"") -> np.ndarray:
        """Byte values, plus 256 where marked; ``before`` are the bytes that came ahead of them."""
        raw = np.frombuffer(before + data, dtype=np.uint8)
        return (raw + repeated(raw) * np.int16(256)).astype(np.int16)[len(before) :]

    def halves(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the rectified filters over steps of ``STEP`` positions, and how many positions each has."""
        n = len(symbols) - WIDTH + 1
        acc = self.taps[0].take(symbols[:n], axis=0)
        for k in range(1, WIDTH):
            acc += self.taps[k].take(symbols[k : n + k], axis=0)
        acc += self.first
        np.maximum(acc, 0, out=acc)
        whole = n // STEP * STEP
        sums = acc[:whole].reshape(-1, STEP, FILTERS).sum(1)
        sizes = np.full(len(sums), STEP)
        if whole < n:
            sums = np.vstack([sums, acc[whole:].sum(0)])
            sizes = np.append(sizes, n - whole)
        return sums, sizes

    def chunks(self, text: bytes) -> np.ndarray:
        """Average filter outputs of each chunk; a chunk is two steps, so chunks overlap by half."""
        pad = b"\n" * (WIDTH - 1)
        sums, sizes, carried = [], [], b""
        overlap = max(LAGS) + 3
        text = text or b"\n"
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK + WIDTH - 1]
            if at + BLOCK >= len(text):
                part = text[at:] + pad
            s, k = self.halves(self.symbols(part, carried))
            carried = text[max(0, at + BLOCK - overlap) : at + BLOCK]
            sums.append(s)
            sizes.append(k)
        total, count = np.vstack(sums), np.concatenate(sizes).astype(np.float32)[:, None]
        if len(total) > 1:
            total, count = total[:-1] + total[1:], count[:-1] + count[1:]
        return total / count

    def probability(self, text: bytes) -> float:
        hidden = np.maximum(self.chunks(text) @ self.mix + self.second, 0).max(0)
        return float(1 / (1 + np.exp(-np.clip(float(hidden @ self.out + self.bias[0]), -50, 50))))


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 10, seed: int = 3, rate: float = 0.01) -> Network:
    net = Network(seed)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 1.0
        net.out[:] = 0
        net.bias[0] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return net
    random = np.random.default_rng(seed)
    symbols = [net.symbols((t or b"\n") + b"\n" * (WIDTH - 1)) for t in texts]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), 32):
            ups = [np.zeros_like(w) for w in net.weights()]
            for d in order[at : at + 32]:
                _backward(net, symbols[d], float(y[d]), float(weight[d]) / 32, ups)
            step += 1
            lower = rate * (1 - epoch / epochs) + 1e-3
            for w, up, (m, v) in zip(net.weights(), ups, moments):
                m += 0.1 * (up - m)
                v += 0.01 * (up * up - v)
                w -= lower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _backward(net: Network, symbols: np.ndarray, y: float, weight: float, ups: list[np.ndarray]) -> None:
    total, count = net.halves(symbols)
    count = count.astype(np.float32)[:, None]
    if len(total) > 1:
        total, count = total[:-1] + total[1:], count[:-1] + count[1:]
    mean = total / count
    hidden = mean @ net.mix + net.second
    won = hidden.argmax(0)
    top = hidden[won, np.arange(HIDDEN)]
    pooled = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(float(pooled @ net.out + net.bias[0]), -50, 50)))
    up = (p - y) * weight
    ups[4] += up * pooled
    ups[5] += up
    up_hidden = up * net.out * (top > 0)
    ups[3] += up_hidden
    ups[2] += mean[won].T * up_hidden
    up_mean = net.mix.T * up_hidden[:, None]  # HIDDEN x FILTERS, of the winning chunks
    n = len(symbols) - WIDTH + 1
    chunks = np.unique(won)
    g = np.stack([up_mean[won == c].sum(0) for c in chunks]) / count[chunks]
    where = chunks[:, None] * STEP + np.arange(CHUNK)
    g = np.repeat(g, CHUNK, 0) * (where < n).reshape(-1, 1)
    where = np.minimum(where, n - 1).reshape(-1)
    taps = [symbols[where + k] for k in range(WIDTH)]
    on = (sum(net.taps[k][taps[k]] for k in range(WIDTH)) + net.first > 0) * g
    ups[1] += on.sum(0)
    for k in range(WIDTH):
        np.add.at(ups[0][k], taps[k], on.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int | None = None) -> Network:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    return fit(*labelled_sample(docs, labels, "quality", per_class, most_bytes))


def score(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; or with ``keep`` all columns of the accepted documents."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 18,000 numbers

    def scores(texts: Iterable[bytes]) -> np.ndarray:
        return np.array([shared.value.probability(bytes(t)) for t in texts], dtype=np.float64)

    if keep:
        (name,) = free_names(docs, 1)

        @F.pandas_udf("double")
        def probability(texts: pd.Series) -> pd.Series:
            return pd.Series(scores(texts))

        return docs.withColumn(name, probability(text_of(text_col).cast("binary"))).where(F.col(name) >= threshold).drop(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = scores(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": found, "predicted": (found >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).cast("binary").alias("text"))
    return through_python(rows, run, "held_out boolean, score double, predicted int")
