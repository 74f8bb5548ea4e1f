"""Best-fit packing: patterns of few documents fitted to the histogram of lengths by non-negative least squares.

1. Documents become token ids plus an end id; only those longer than a sequence are cut.
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) goes to the driver.
3. Lengths are grouped into at most ``MOST_BINS`` bins of neighbouring lengths, so that a bin has pieces for many
   sequences (in a large corpus a bin is one length or a few). Patterns of up to ``MOST_IN_PATTERN`` bins whose
   longest pieces just fill a sequence are enumerated, and their repeat counts fitted to the bins by
   non-negative least squares (an active set, so that few patterns carry the fit), then rounded down.
4. What the patterns leave over is packed best-fit, longest first, into the room at the end of
   pattern sequences and into new ones, by counts.
5. The plan is a list of runs: pieces of one length, numbers a to b of that length, go to sequences
   s, s+1, ... at one offset. Its size is bounded by bins, patterns and lengths, and not by the corpus.
6. Pieces of one length are numbered by ranges of a seeded order that also parts equal pieces, so
   that a length which a third of all pieces share is no single task, and look up their run.

Defined results: null text is empty and gives one piece of one id (the end id); repeated rows are
packed each; ids may be null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import numbered
from .common import ChunkTable, Workspace, groups, no_cycles, text_of, tidied

END = 1
MOST_IN_PATTERN = 5
MOST_BINS = 192
#: Share of all tokens, in the shortest pieces, that is kept to fill the room at the end of pattern sequences.
FILLING = 0.06
#: Patterns kept for each longest bin: those that fill a sequence best.
EACH = 48
#: What the normaliser's ``\s`` matches.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Texts of these characters only are cut into pre-tokens here: NFC leaves them, each lower-cases alone, and none but those of ``PRE_TOKEN`` are letters or digits.
EASY = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u00a1\u00bf\u00ab\u00bb\u2013\u2014\u2018\u2019\u201c\u201d\u2026]*")
PRE_TOKEN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Stands for the end of a word in the merge table; words that hold it go to the library.
MARK = b"\x7f"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The vocabulary's merges as ranks of byte strings, for an engine that merges the pair of the lowest rank first.

    A word's last symbol bears the end mark, which becomes a byte of its own that merges before anything else.
    The engine merges any pair whose joint string has a rank, the library only the pair that is listed. Both give the same if
    each listed string, taken alone, comes out as one token; ``check`` proves that for a vocabulary.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"]:
            raise ValueError("not a vocabulary of merges with word ends")
        symbols, vocab = byte_symbols(), model["vocab"]

        def raw(token: str) -> bytes:
            body, end = (token[:-4], MARK) if token.endswith("</w>") else (token, b"")
            return bytes(symbols[c] for c in body) + end

        self.ranks = {bytes([b]): b for b in range(256)}
        self.pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids = np.zeros(512 + len(self.pairs), dtype="<u4")
        self.last = np.zeros(len(self.ids), dtype=bool)
        for c, b in symbols.items():
            self.ids[b], self.ids[256 + b], self.last[256 + b] = vocab[c], vocab[c + "</w>"], True
            self.ranks[bytes([b]) + MARK] = 256 + b
        for k, (a, b) in enumerate(self.pairs, 512):
            if raw(a + b) in self.ranks:
                raise ValueError("a string is merged in two ways")
            self.ranks[raw(a + b)], self.ids[k], self.last[k] = k, vocab[a + b], b.endswith("</w>")
        self.engine = tiktoken.Encoding("merges", pat_str="[^\x7f]+\x7f", mergeable_ranks=self.ranks, special_tokens={})
        del self.ranks

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """Little-endian ids of words without the mark, each one pre-token."""
        found = np.array(self.engine.encode_ordinary("\x7f".join([*words, ""])), dtype=np.int64)
        packed, start = self.ids[found].tobytes(), 0
        for end in (4 * (np.flatnonzero(self.last[found]) + 1)).tolist():
            yield packed[start:end]
            start = end

    def check(self) -> bool:
        """Whether each listed string, taken alone and merged by listed pairs only, becomes one token."""
        order = {pair: k for k, pair in enumerate(self.pairs)}
        for a, b in self.pairs:
            body, end = ((a + b)[:-4], True) if b.endswith("</w>") else (a + b, False)
            parts = [*body[:-1], body[-1] + "</w>" * end]
            while len(parts) > 1:
                k = min(range(len(parts) - 1), key=lambda k: order.get((parts[k], parts[k + 1]), len(order)))
                if (parts[k], parts[k + 1]) not in order:
                    return False
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True


class WordTokenizer:
    """Token ids through a table of distinct pre-tokens, in bytes bounded."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.merges = path, Merges(path)
        self.words = ChunkTable(self._words)
        self.chunks = ChunkTable(self._library)

    @cached_property
    def library(self):
        """Loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _words(self, words: list[str]) -> Iterator[bytes]:
        plain = self.merges.encode([w for w in words if "\x7f" not in w])
        for w in words:
            yield next(self._library([w])) if "\x7f" in w else next(plain)

    def _library(self, chunks: list[str]) -> Iterator[bytes]:
        for found in self.library.encode_batch_fast(chunks, add_special_tokens=False):
            yield np.array(found.ids, dtype="<u4").tobytes()

    def forget(self) -> None:
        self.words.forget()
        self.chunks.forget()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        for run in groups(texts):
            easy = [EASY.fullmatch(t) is not None and "<|" not in t for t in run]
            # No token crosses white space, so the chunks of other texts are encoded alone.
            cut = [PRE_TOKEN.findall(t.lower()) if e else [c for c in SPACE.split(t) if c] for t, e in zip(run, easy)]
            self.words.learn([c for c, e in zip(cut, easy) if e])
            self.chunks.learn([c for c, e in zip(cut, easy) if not e])
            for c, e in zip(cut, easy):
                yield b"".join(map((self.words if e else self.chunks).__getitem__, c))


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids, if asked for)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = array("I", [END]).tobytes()
        with no_cycles():
            for batch in batches:
                rows: list[list] = [[], [], [], [], [], []]
                for k, ids in enumerate(tokenizer(path).encode(t.as_py() for t in batch.column(1))):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, dtype="<u4").astype("i4") if with_ids else None)):
                            column.append(value)
                columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:5]]]
                columns += [pa.array(rows[5], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            tokenizer(path).forget()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidied(run), schema)


class Bins:
    """Runs of neighbouring lengths. Full pieces, which need no company, and the shortest, which fill what patterns leave, are no part of it."""

    def __init__(self, counts: np.ndarray, capacity: int, most: int = MOST_BINS) -> None:
        tokens = np.cumsum((counts * np.arange(len(counts)))[:capacity])
        lengths = np.flatnonzero(counts[:capacity])
        lengths = lengths[tokens[lengths] > FILLING * tokens[-1]]
        n = counts[lengths].astype(np.float64)
        # Cut by a measure that gives each piece a share and each token a share: bins are narrow where long pieces are.
        weight = np.cumsum(n / max(1.0, n.sum()) + n * lengths / max(1.0, (n * lengths).sum()))
        cut = np.floor(weight * (most / 2 - 1e-9)) if len(lengths) > most else np.arange(len(lengths))
        first = np.flatnonzero(np.append(True, cut[1:] != cut[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)
        self.members = [lengths[a:b] for a, b in zip(first, np.append(first[1:], len(lengths)))]
        self.middle = np.array([-(-int((m * counts[m]).sum()) // int(counts[m].sum())) for m in self.members], dtype=np.int64)
        self.counts = np.array([counts[m].sum() for m in self.members], dtype=np.int64)


def patterns(middle: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Bins, longest first, whose mean pieces just fill a sequence: for each first bin the ``EACH`` fullest of several splits of the rest."""
    found: dict[tuple[int, ...], None] = {}
    for first in range(len(middle) - 1, -1, -1):
        rest = capacity - int(middle[first])
        seen: dict[tuple[int, ...], int] = {}
        for second in range(min(first, int(np.searchsorted(middle, rest, side="right")) - 1), -1, -1):
            left, chosen = rest - int(middle[second]), [first, second]
            seen[tuple(chosen)] = left
            # The rest greedily: the longest bin that fits, and with one that leaves half of it.
            for half in (False, True):
                more, room = list(chosen), left
                while len(more) < MOST_IN_PATTERN:
                    at = int(np.searchsorted(middle, room // 2 if half and len(more) == 2 else room, side="right")) - 1
                    at = min(at, more[-1])
                    if at < 0:
                        break
                    more.append(at)
                    room -= int(middle[at])
                    seen[tuple(more)] = room
        best = sorted(seen, key=lambda p: (seen[p], p))
        found |= dict.fromkeys(p for p in best[:EACH] if seen[p] <= capacity // 16)
    return list(found)


def fit(counts: np.ndarray, found: list[tuple[int, ...]]) -> np.ndarray:
    """x >= 0 that makes |Ax - counts| least, A's columns being the patterns: the active-set method, whose solution has at most as many patterns as bins."""
    x = np.zeros(len(found))
    if not found:
        return x
    a = np.zeros((len(counts), len(found)))
    for k, p in enumerate(found):
        np.add.at(a[:, k], list(p), 1.0)
    target, active = counts.astype(np.float64), np.zeros(len(found), dtype=bool)
    least = 1e-7 * max(1.0, float(np.abs(a.T @ target).max()))
    for _ in range(3 * len(counts)):
        gain = a.T @ (target - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= least:
            break
        active[best] = True
        while True:
            own = np.flatnonzero(active)
            z = _least_squares(a[:, own], target)
            low = z <= 1e-9
            if not low.any():
                break
            step = (x[own] / np.maximum(x[own] - z, 1e-12))[low].min()
            x[own] += step * (z - x[own])
            gone = own[low & (x[own] <= 1e-9)]
            gone = gone if len(gone) else own[low][:1]
            active[gone], x[gone] = False, 0.0
            if not active.any():
                return x
        x[:] = 0
        x[own] = z
    return x


def _least_squares(a: np.ndarray, target: np.ndarray) -> np.ndarray:
    try:
        z = np.linalg.solve(a.T @ a, a.T @ target)
        if np.isfinite(z).all() and np.abs(a.T @ (a @ z - target)).max() <= 1e-6 * max(1.0, np.abs(target).max()):
            return z
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, target, rcond=None)[0]


class Plan:
    """Where each piece goes. ``runs[length]`` lists (number of the first piece, sequence, offset); ``fitted`` counts sequences that patterns began."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        left, self.used = counts.astype(np.int64).copy(), np.zeros(len(counts), dtype=np.int64)
        if left[capacity]:
            self._put(capacity, int(left[capacity]), 0, 0)
            self.sequences, left[capacity] = int(left[capacity]), 0
        self.full = self.sequences
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        bins = Bins(left, capacity)
        found = patterns(bins.middle, capacity)
        x = np.floor(fit(bins.counts, found) + 1e-6).astype(np.int64)
        there = bins.counts.copy()
        for k in np.argsort(-x, kind="stable").tolist():
            need = np.bincount(found[k], minlength=len(there))
            most = int(min(x[k], (there[need > 0] // need[need > 0]).min()))
            if most > 0:
                there -= most * need
                self._repeat(found[k], bins, left, most)
        self.fitted = self.sequences - self.full
        self._best_fit(left)

    def _repeat(self, pattern: tuple[int, ...], bins: Bins, left: np.ndarray, most: int) -> None:
        """Up to ``most`` sequences of a pattern, as many equal ones at a time as there are.

        Bins but the last two give the middle one of their lengths that are left; the last two give the pair that leaves the least room.
        """
        while most:
            chosen: list[int] = []

            def free(b: int, n: int = 0) -> np.ndarray:
                return np.array([m for m in bins.members[b].tolist() if left[m] > chosen.count(m) + n], dtype=np.int64)

            for b in pattern[:-2]:
                here = free(b)
                if not len(here):
                    return
                chosen.append(int(here[len(here) // 2]))
            room = self.capacity - sum(chosen)
            one, other = free(pattern[-2]), free(pattern[-1])
            fits = np.searchsorted(other, room - one, side="right") - 1 if len(other) else np.full(len(one), -1)
            gap = np.where(fits >= 0, room - one - other[np.maximum(fits, 0)] if len(other) else 0, self.capacity)
            if pattern[-2] == pattern[-1]:
                gap[(one == other[np.maximum(fits, 0)]) & ~np.isin(one, free(pattern[-1], 1))] = self.capacity
            if not len(gap) or gap.min() >= self.capacity:
                return
            k = np.flatnonzero(gap == gap.min())
            k = int(k[len(k) // 2])
            chosen += [int(one[k]), int(other[fits[k]])]
            taken, n = np.unique(chosen, return_counts=True)
            many, offset = int(min(most, (left[taken] // n).min())), 0
            for length in chosen:
                self._put(length, many, self.sequences, offset)
                left[length] -= many
                offset += length
            self._open(self.capacity - offset, self.sequences, many)
            self.sequences += many
            most -= many

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs[length].append((int(self.used[length]), sequence, offset))
        self.used[length] += n

    def _best_fit(self, left: np.ndarray) -> None:
        """Longest first, each piece into the fullest open sequence with room, many equal ones at a time."""
        for length in np.flatnonzero(left)[::-1].tolist():
            n = int(left[length])
            while n:
                at = np.searchsorted(self.rooms, length)
                if at == len(self.rooms):
                    # A new sequence takes as many as fit in it.
                    each = self.capacity // length
                    whole, part = divmod(n, each)
                    for k, many in ((each, whole), (part, 1 if part else 0)):
                        if many:
                            for i in range(k):
                                self._put(length, many, self.sequences, i * length)
                            self._open(self.capacity - k * length, self.sequences, many)
                            self.sequences += many
                    n = 0
                else:
                    r = self.rooms[at]
                    sequence, many = self.room[r].pop()
                    if not self.room[r]:
                        self.rooms.pop(at)
                    took = min(n, many)
                    if took < many:
                        self._open(r, sequence + took, many - took)
                    self._put(length, took, sequence, self.capacity - r)
                    self._open(r - length, sequence, took)
                    n -= took

    def _open(self, r: int, sequence: int, many: int) -> None:
        if r:
            if not self.room[r]:
                self.rooms.insert(int(np.searchsorted(self.rooms, r)), r)
            self.room[r].append((sequence, many))

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(runs, dtype=np.int64).T for length, runs in self.runs.items()}


def pack(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = space.table(pieces(docs, path, capacity, id_col, text_col).withColumn("own", F.monotonically_increasing_id()), "pieces")

    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).arrays())

    # Pieces of one length are numbered in a seeded order, in which pieces that are alike are told apart by the number they were written with.
    first = spark.sparkContext.broadcast(np.cumsum(counts) - counts)
    order = [F.col("length"), F.xxhash64("doc_id", "piece", "ids_crc32"), *[F.col(c) for c in ("doc_id", "piece", "ids_crc32", "own")]]
    ranked = numbered(rows, order, "number", space).select("doc_id", "piece", "start", "length", "ids_crc32", "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() - first.value[length]
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                runs = plan.value[int(length[at[0]])]
                k = np.searchsorted(runs[0], number[at], side="right") - 1
                sequence[at] = runs[1, k] + number[at] - runs[0, k]
                offset[at] = runs[2, k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
