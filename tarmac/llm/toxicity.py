"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6, with word ends marked), each hashed to an
embedding; unseen misspellings share most n-grams with what was learned. A run of more than ``LONGEST``
characters without white space (joined words, CJK or Thai script, addresses) counts as several words: pieces of ``PIECE`` characters that
overlap, so that each of its n-grams is in one of them. A window of ``WINDOW`` words is
the average of its words, and a linear softmax of that average gives its probability. Windows
overlap by half and cover the whole text; a document scores as its worst window does, so one
abusive passage shows in a long text; a word right after itself adds nothing. Training runs through the same windows: each epoch takes every
document's worst window so far, and updates embeddings and softmax together. Embeddings start from the
log-odds of an n-gram's documents, so that the first choice of worst windows means something.

Since the softmax is linear, a word's share of a window's margin is one number; it is computed once
for each distinct word and looked up.

Defined results: null and empty texts, and texts without word characters, get the score of a window
of words that all say nothing; repeated rows score alike; without labelled rows of both classes all
scores are the share of toxic labels seen (0 if none). Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkTable, groups, held_out, labelled_sample, no_cycles, text_of, through_python

BUCKETS = 1 << 16
DIMS = 4
WINDOW = 8
STEP = 4
#: Bound of the training sample: labelled documents of each class.
PER_CLASS = 1500
#: Longest run that is one word; pieces of longer ones, which share one character less than the longest n-gram.
LONGEST, PIECE, SHARED = 64, 16, 5
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def tokens(text: str) -> list[str]:
    """Lower-cased words. A piece of a long run has a space before it; a long run right after itself is one empty piece."""
    words = text.lower().split()
    if len(max(words, key=len, default="")) <= LONGEST:
        return words
    out: list[str] = []
    for w, before in zip(words, ["", *words]):
        core = EDGE.sub("", w) if len(w) > LONGEST else w
        if len(core) <= LONGEST:
            out.append(w)
        elif w == before:
            out.append(" ")
        else:
            marked = f"<{core}>"
            out += [" " + marked[i : i + PIECE] for i in range(0, len(marked) - SHARED, PIECE - SHARED)]
    return out


def grams(word: str) -> list[int]:
    """Hashed n-grams of one of ``tokens``; none if it has no word characters."""
    if word.startswith(" "):
        marked = word[1:]
    else:
        core = EDGE.sub("", word)
        marked = f"<{core}>" if core else ""
    if not marked:
        return []
    return [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for n in (3, 4, 5, 6) for i in range(max(1, len(marked) - n + 1))]


def again(words: list[str]) -> np.ndarray:
    """Which words are right after themselves: they keep their places in windows and add nothing, in training and scoring."""
    return np.fromiter(map(eq, words, ["", *words]), dtype=bool, count=len(words))


class Model:
    """Word margins are ``known * (embeddings @ direction)`` averaged over a word's n-grams."""

    def __init__(self, gram_margin: np.ndarray, bias: float, words: ChunkTable | None = None) -> None:
        self.gram_margin, self.bias = gram_margin, bias
        self.words = ChunkTable(self._margins)

    def __reduce__(self) -> tuple:
        return Model, (self.gram_margin, self.bias)

    def _margins(self, words: list[str]) -> Iterator[float]:
        for at in range(0, len(words), 20_000):
            bags = [grams(w) for w in words[at : at + 20_000]]
            sizes = np.array([len(b) for b in bags])
            flat = self.gram_margin[np.fromiter((g for b in bags for g in b), dtype=np.int64, count=int(sizes.sum()))]
            sums = np.bincount(np.repeat(np.arange(len(bags)), sizes), flat, len(bags))
            yield from (sums / np.maximum(sizes, 1)).tolist()

    def score(self, texts: Iterable[str]) -> Iterator[float]:
        for run in groups(texts):
            cut = [tokens(t) for t in run]
            self.words.learn(cut)
            for words in cut:
                margins = np.fromiter(map(self.words.__getitem__, words), dtype=np.float64, count=len(words))
                margins[again(words)] = 0
                yield float(1 / (1 + np.exp(-np.clip(self.bias + worst(margins)[0], -500, 500))))


def worst(margins: np.ndarray) -> tuple[float, int]:
    """Largest window average and where the window starts. A short text is one window, averaged as if filled up."""
    n = len(margins)
    if n <= WINDOW:
        return float(margins.sum() / WINDOW), 0
    total = np.concatenate(([0.0], np.cumsum(margins)))
    starts = np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)
    means = (total[starts + WINDOW] - total[starts]) / WINDOW
    k = int(np.argmax(means))
    return float(means[k]), int(starts[k])


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 20, seed: int = 5) -> Model:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    random = np.random.default_rng(seed)
    bags: dict[str, list[int]] = {}
    docs = []
    for t in texts:
        words = tokens(t.decode("utf-8", "ignore"))
        for w in words:
            if w not in bags:
                bags[w] = grams(w)
        docs.append([[] if twice else bags[w] for w, twice in zip(words, again(words))])
    flat = [np.fromiter((g for w in words for g in w), dtype=np.int64) for words in docs]
    sizes = [np.fromiter(map(len, words), dtype=np.int64, count=len(words)) for words in docs]
    spread = np.zeros((2, BUCKETS))
    for g, label in zip(flat, y):
        spread[int(label), np.unique(g)] += 1
    known = (spread.sum(0) >= 3).astype(np.float64)
    odds = np.log((spread[1] + 1) / ((y == 1).sum() + 2)) - np.log((spread[0] + 1) / ((y == 0).sum() + 2))
    embed = random.normal(0, 0.05, (BUCKETS, DIMS))
    embed[:, 0] = odds * known
    soft = random.normal(0, 0.1, (DIMS, 2))
    soft[0] = -4.0, 4.0
    bias = np.zeros(2)
    step_embed, step_soft, step_bias = np.full(BUCKETS, 1e-6), np.full((DIMS, 2), 1e-2), np.full(2, 1e-2)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    ends = [np.concatenate(([0], np.cumsum(s))) for s in sizes]
    words_of = [np.repeat(np.arange(len(s)), s) for s in sizes]
    for _ in range(epochs):
        margin = known * (embed @ (soft[:, 1] - soft[:, 0]))
        windows = []
        for g, s, of in zip(flat, sizes, words_of):
            start = worst(np.bincount(of, margin[g], len(s)) / np.maximum(s, 1))[1]
            windows.append((start, min(len(s), start + WINDOW)))
        order = random.permutation(len(docs))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            parts, rows, shares = [], [], []
            for k, d in enumerate(batch):
                a, b = windows[d]
                parts.append(flat[d][ends[d][a] : ends[d][b]])
                rows.append(np.full(len(parts[-1]), k))
                shares.append(np.repeat(1 / np.maximum(sizes[d][a:b], 1), sizes[d][a:b]) / WINDOW)
            ids, rows = np.concatenate(parts), np.concatenate(rows)
            share = (np.concatenate(shares) * known[ids])[:, None]
            mean = np.stack([np.bincount(rows, c, len(batch)) for c in (embed[ids] * share).T], 1)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch].astype(int)] -= 1
            p *= weight[batch][:, None] / len(batch)
            up_soft, up_bias, up_mean = mean.T @ p + 1e-5 * soft, p.sum(0), p @ soft.T
            touched, inverse = np.unique(ids, return_inverse=True)
            up = np.stack([np.bincount(inverse, c, len(touched)) for c in (up_mean[rows] * share).T], 1)
            step_embed[touched] += (up**2).mean(1)
            embed[touched] -= 0.5 * up / np.sqrt(step_embed[touched])[:, None]
            step_soft += up_soft**2
            soft -= 0.3 * up_soft / np.sqrt(step_soft)
            step_bias += up_bias**2
            bias -= 0.1 * up_bias / np.sqrt(step_bias)
    return Model(known * (embed @ (soft[:, 1] - soft[:, 0])), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int | None = None) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    return fit(*labelled_sample(docs, labels, "toxic", per_class, most_bytes))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with no_cycles():
            for batch in batches:
                scores = np.fromiter(shared.value.score(batch["text"]), dtype=np.float64, count=len(batch))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": (scores >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return through_python(rows, run, "held_out boolean, score double, predicted int")
