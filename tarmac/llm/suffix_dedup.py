"""Removal of repeated passages by distributed prefix doubling over sampled positions.

A byte goes if a string of ``SPAN`` bytes that also starts elsewhere covers it. Ranking every position of
a corpus would shuffle many times its size, so positions are sampled without loss first:

* Sampling. Each window of ``SPAN`` bytes is in the charge of one position inside it, that of the smallest hash
  of ``GRAM`` bytes (leftmost of equal ones). Equal windows have their position at the same place, so only
  windows in the charge of positions with equal first ``GRAM`` bytes can be equal. About one position in 75 is charged;
  those with unique grams drop out.
* Contexts. A position with all bytes that its windows cover is counted by these. Where they occur again, all
  its windows do. Copies of documents end here, however many there are, and one context of each kind goes on.

What is left has the same gram in different contexts. There prefix doubling runs on a grid of ``CELL`` bytes that the
charged position anchors, so that equal windows meet the grid at the same places:

* First ranks are names of the ``FIRST`` = 48 bytes at each place of the grid.
* Each round pairs a place's rank with that of the place one length further on, sorts the pairs by range over the cluster and ranks
  them anew by their places in that order, for strings of twice the length: 96, then 192 bytes, which all windows of one cell of the grid share.
  Unique pairs drop out, and so do those that only positions have which are done already.
* Rounds stop when nothing is left that occurs again, or at the threshold. A window of 200 bytes is a string of 192 with the 8
  bytes around it, so the last round ranks the pair of the rank and those bytes themselves. Cells whose bytes on both sides occur again as a
  whole are done at once.

First names, grams and contexts are 64-bit hashes (a window counts as repeated by the gram and the context together, 128 bits, or by ranks whose
every step is exact from the first names on); the last bytes are compared as they are.

Spark does the ranking: names are counted with partial aggregates, and a name that very many positions
share is one row a task. Joins back are on names, where skewed ones can be split. Texts are
shuffled only for documents that hold an undecided context or lose bytes, picked by a filter of bounded size.

Defined results: null text is empty; texts shorter than ``SPAN`` bytes lose nothing; rows equal in id and text are
two occurrences of their text; matches never cross documents; an empty table gives an empty result; other
columns are kept by ``keep`` and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import numbered
from .common import Bitmap, Workspace, among, free_names, text_of, through_python, tidied
from .rolling import Base, Rolling

SPAN = 200
GRAM = 50
CELL = 8
FIRST = 48
CORE = SPAN - CELL  # what all windows of a cell share: 4 * FIRST bytes
WIDE = SPAN - GRAM  # largest distance from a window's start to its position
BLOCK = 1 << 18
#: Steps of the grid that an offset of FIRST bytes is.
HOP = FIRST // CELL
_FIRST, _SECOND = Base(101), Base(202)
_LOW = np.uint64(0xFFFFFF)


def charged(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: document, name of the gram, name of the context, and lo, hi, position of each charge."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none, none
    first, second = Rolling(data, _FIRST), Rolling(data, _SECOND)
    grams = first.grams(GRAM)
    low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    count, size, n = WIDE + 1, 1, len(grams) - WIDE
    while size * 2 <= count:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    at = (np.minimum(low[:n], low[count - size : count - size + n]) & _LOW).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), ends - starts)[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + SPAN <= ends[doc])
    if not len(inside):
        return none, none, none, none, none, none
    at = at[inside]
    cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    a, lo = at[cut], inside[cut]
    hi = inside[np.append(cut[1:], len(inside)) - 1]
    context = second.of(lo, hi + SPAN) ^ (hi - lo).astype(np.uint64)
    return doc[lo], grams[a].view(np.int64), context.view(np.int64), lo, hi, a


def _runs(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of texts, their bytes laid end to end, ends, and where each begins in its text. Long texts come in overlapping blocks."""
    numbers, parts, offsets, size = [], [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - SPAN + 1), BLOCK):
            part = text[at : at + BLOCK + SPAN - 1]
            if parts and size + len(part) > BLOCK:
                yield numbers, np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]), np.array(offsets)
                numbers, parts, offsets, size = [], [], [], 0
            numbers.append(number)
            parts.append(part)
            offsets.append(at)
            size += len(part)
    if parts:
        yield numbers, np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]), np.array(offsets)


def pack(lo: np.ndarray, hi: np.ndarray, a: np.ndarray) -> np.ndarray:
    return (lo << 16) | ((hi - lo) << 8) | (a - lo)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 16
    return lo, lo + ((place >> 8) & 255), lo + (place & 255)


def _charges(rows: DataFrame) -> DataFrame:
    """(at, gram, context, place): every charge. Of equal contexts inside a document the first two are given, and the rest as spans (gram null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["at"].to_numpy(dtype=np.int64)
            for numbers, data, ends, offsets in _runs([bytes(t) for t in batch["text"]]):
                doc, gram, context, lo, hi, a = charged(data, ends)
                if not len(doc):
                    continue
                frame = pd.DataFrame({"doc": doc, "gram": gram, "context": context})
                number = frame.groupby(["doc", "gram", "context"]).cumcount().to_numpy()
                shift = offsets[doc] - np.concatenate(([0], ends[:-1]))[doc]
                place = pack(lo + shift, hi + shift, a + shift)
                out = pd.DataFrame({"at": keys[np.array(numbers)[doc]], "gram": pd.array(gram, dtype="Int64"), "context": context, "place": place})
                out.loc[number >= 2, "gram"] = pd.NA
                yield out

    return rows.mapInPandas(tidied(run), "at long, gram long, context long, place long")


def _contexts(rows: DataFrame) -> DataFrame:
    """(at, place, open, bytes) of contexts listed with the documents they are in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, text, listed in batch[["at", "text", "listed"]].itertuples(index=False):
                for r in listed:
                    lo, hi, _ = unpack(r["place"])
                    out.append((at, r["place"], r["open"], bytes(text[lo : hi + SPAN])))
            yield pd.DataFrame(out, columns=["at", "place", "open", "bytes"])

    return rows.mapInPandas(tidied(run), "at long, place long, open boolean, bytes binary")


def _first_pairs(contexts: DataFrame) -> DataFrame:
    """(context, c, open, r1, r2): names of the first bytes at each place c of the grid and of those one length further on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            data = np.frombuffer(b"".join(batch["bytes"]), dtype=np.uint8)
            sizes = batch["bytes"].map(len).to_numpy(dtype=np.int64)
            lo, hi, a = unpack(batch["place"].to_numpy(dtype=np.int64))
            at = np.cumsum(sizes) - sizes - lo + a
            low, high = (a - hi) // CELL - 2 * HOP, (a - lo) // CELL
            n = high - low + 1
            row = np.repeat(np.arange(len(batch)), n)
            c = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
            place, names = at[row] - c * CELL, Rolling(data, _SECOND)
            first, onward = (names.of(x, x + FIRST).view(np.int64) for x in (place, place + FIRST))
            yield pd.DataFrame({"context": batch["context"].to_numpy()[row], "c": c.astype(np.int32), "open": batch["open"].to_numpy()[row], "r1": first, "r2": onward})

    return contexts.select("context", "place", "open", "bytes").mapInPandas(tidied(run), "context long, c int, open boolean, r1 long, r2 long")


def _cells(ranked: DataFrame) -> DataFrame:
    """(at, place, open, c, rank, low, high, left, right) of cells whose core has a rank: windows low to high start so many bytes before it; 8 bytes on both sides of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for at, place, open_, text, ranks in batch[["at", "place", "open", "bytes", "ranks"]].itertuples(index=False):
                lo, hi, a = (int(x) for x in unpack(place))
                wide = bytes(CELL) + bytes(text) + bytes(CELL)
                for r in ranks:
                    c = r["c"]
                    if (a - hi) // CELL <= c <= (a - lo) // CELL:
                        core = a - c * CELL - lo + CELL
                        low, high = max(0, a - hi - c * CELL), min(CELL - 1, a - lo - c * CELL)
                        left, right = int.from_bytes(wide[core - CELL : core], "big", signed=True), int.from_bytes(wide[core + CORE : core + SPAN], "big", signed=True)
                        out.append((at, place, open_, c, r["rank"], low, high, left, right))
            yield pd.DataFrame(out, columns=["at", "place", "open", "c", "rank", "low", "high", "left", "right"])

    return ranked.mapInPandas(tidied(run), "at long, place long, open boolean, c int, rank long, low int, high int, left long, right long")


def rerank(rows: DataFrame, space: Workspace) -> DataFrame:
    """(context, c, open, rank): places of pairs of ranks in their order, for those that occur again and somewhere in an open context."""
    by = ["r1", "r2"]
    again = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("open").alias("any")).where("n > 1 and any").select(*by)
    ranks = numbered(space.table(again, "again"), [F.col(c) for c in by], "rank", space)
    return space.table(rows.join(ranks, by).select("context", "c", "open", "rank"), "ranks")


def doubled(ranks: DataFrame, length: int) -> DataFrame:
    """(context, c, open, r1, r2): ranks of strings of a length with those one length further on."""
    hop = length // CELL
    onward = Window.partitionBy("context").orderBy("c").rangeBetween(-hop, -hop)
    return ranks.select("context", "c", "open", F.col("rank").alias("r1"), F.max("rank").over(onward).alias("r2")).where("r2 is not null")


def _left(n: Column) -> Column:
    """The last n (fewer than 8) of the 8 bytes before a core."""
    return F.col("left").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n * 8) - 1)


def _right(n: Column) -> Column:
    """The first n (at least 1) of the 8 bytes behind a core."""
    return F.call_function("shiftrightunsigned", F.col("right"), (CELL - n) * 8)


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint maximal runs of spans; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return list(zip(starts[cut].tolist(), ends[np.append(cut[1:], len(ends)) - 1].tolist()))


class RepeatedPassages:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.space = Workspace(docs.sparkSession, "suffix-dedup")
        text = text_of(text_col)
        self.key = F.xxhash64(F.col(id_col), text)
        self.source = docs.select(self.key.alias("at"), text.cast("binary").alias("text"))

    def spans(self) -> DataFrame:
        """(at, start, end): spans of repeated windows; they overlap."""
        space = self.space
        all_charges = space.table(_charges(self.source.where(F.octet_length("text") >= SPAN)), "charges")
        charges = all_charges.where("gram is not null")
        again = all_charges.where("gram is null").select("at", "place")

        # Length 50: unique names drop out.
        grams = charges.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
        left = space.table(charges.join(grams, "gram", "left_semi"), "repeated")
        # Whole contexts: those that occur again are done.
        contexts = left.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("at", "place")).alias("one"))
        contexts = space.table(contexts, "contexts")
        done = left.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"]).select("at", "place").unionByName(again)
        spans = [done.select("at", *_extent())]

        # Contexts with others of the same gram, one place of each.
        mixed = contexts.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("gram")
        listed = contexts.join(mixed, "gram", "left_semi").select("one.at", "one.place", (F.col("n") == 1).alias("open"))
        listed = space.table(listed.groupBy("at").agg(F.collect_list(F.struct("place", "open")).alias("listed")), "listed")
        wanted = Bitmap.of(listed.select(F.col("at").alias("key")))
        texts = self.source.where(among(wanted, True)("at"))
        held = _contexts(texts.join(listed, "at")).dropDuplicates(["at", "place"])
        held = space.table(held.withColumn("context", F.monotonically_increasing_id()), "bytes")

        # Pairs at offset 48, then at offset 96.
        length, pairs, ranks = 2 * FIRST, space.table(_first_pairs(held), "pairs"), None
        while True:
            ranks = rerank(pairs, space)
            space.drop(pairs)
            if length >= CORE or ranks.isEmpty():
                break
            pairs = space.table(doubled(ranks, length), "pairs")
            length *= 2
        listed = ranks.groupBy("context").agg(F.collect_list(F.struct("c", "rank")).alias("ranks"))  # fewer than 50 places of the grid to a context
        third = space.table(_cells(held.join(listed, "context")), "cores")
        space.drop(held)

        # Past the threshold: the bytes around, of a whole cell and then of its windows.
        around = ["rank", "low", "high", "before", "behind"]
        cells = third.withColumn("before", _left(F.col("high"))).withColumn("behind", _right(CELL - F.col("low")))
        again = cells.groupBy(*around).agg(F.count("*").alias("n")).where("n > 1").select(*around, F.lit(True).alias("again"))
        cells = space.table(cells.join(again, around, "left"), "cells")
        space.drop(third)
        lo, a = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(255))
        start = lo + a - F.col("c") * CELL
        sure = cells.where("open and again")
        spans.append(sure.select("at", (start - F.col("high")).alias("start"), (start - F.col("low") + SPAN).alias("end")))
        doubtful = cells.where("open and again is null").select("rank").distinct()
        windows = cells.join(doubtful, "rank", "left_semi").withColumn("i", F.explode(F.sequence("low", "high")))
        sides = F.call_function("shiftleft", _left(F.col("i")), (CELL - F.col("i")) * 8).bitwiseOR(_right(CELL - F.col("i")))
        windows = windows.select("at", (start - F.col("i")).alias("p"), (F.col("open") & F.col("again").isNull()).alias("asked"), "rank", "i", sides.alias("sides"))
        windows = space.table(windows, "windows")
        names = windows.groupBy("rank", "i", "sides").agg(F.count("*").alias("n"), F.max("asked").alias("any")).where("n > 1 and any").select("rank", "i", "sides")
        found = windows.where("asked").join(names, ["rank", "i", "sides"], "left_semi")
        spans.append(found.select("at", F.col("p").alias("start"), (F.col("p") + SPAN).alias("end")))
        return spans[0].unionByName(spans[1]).unionByName(spans[2])

    def runs(self) -> DataFrame:
        """(at, spans): the maximal removed runs of each document that loses bytes."""
        listed = self.spans().groupBy("at").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                merged = [merge(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans])) for spans in batch["spans"]]
                yield pd.DataFrame({"at": batch["at"], "spans": [[{"start": a, "end": b} for a, b in m] for m in merged]})

        return self.space.table(listed.mapInPandas(tidied(run), "at long, spans array<struct<start: long, end: long>>"), "runs")

    def result(self) -> DataFrame:
        """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
        runs = self.runs()
        losing = Bitmap.of(runs.select(F.col("at").alias("key")))
        rows = self.docs.select(F.col(self.id_col).alias("doc_id"), self.key.alias("at"), text_of(self.text_col).cast("binary").alias("text"))
        whole = [F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
        clean = rows.where(among(losing, False)("at")).select("doc_id", *whole)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc_id, text, spans in batch[["doc_id", "text", "spans"]].itertuples(index=False):
                    spans = [] if spans is None else [(s["start"], s["end"]) for s in spans]
                    out.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(bytes(text), spans)).hexdigest()))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        cut = rows.where(among(losing, True)("at")).join(runs, "at", "left")
        return clean.unionByName(through_python(cut, run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))

    def keep(self) -> DataFrame:
        """The documents with their texts less the repeated passages, and all other columns."""
        key, at, spans = free_names(self.docs, 3)
        runs = self.runs().select(F.col("at").alias(at), F.col("spans").alias(spans))
        losing = Bitmap.of(runs.select(F.col(at).alias("key")))
        rows = self.docs.withColumn(key, self.key)
        clean = rows.where(among(losing, False)(key)).drop(key)
        cut = rows.where(among(losing, True)(key)).join(runs, F.col(key) == F.col(at), "left")
        shorter = cut.withColumn(self.text_col, F.when(F.col(spans).isNull(), F.col(self.text_col)).otherwise(_shorter(text_of(self.text_col).cast("binary"), F.to_json(spans))))
        return clean.unionByName(shorter.select(*clean.columns))


def _extent() -> tuple:
    low = F.shiftright("place", 16)
    return low.alias("start"), (low + F.shiftright("place", 8).bitwiseAND(F.lit(255)) + SPAN).alias("end")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def _shorter(text, spans):
    import json

    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series, listed: pd.Series) -> pd.Series:
        # A cut inside a character leaves bytes that are no UTF-8; they are dropped from the text.
        return pd.Series([without(bytes(t), [(s["start"], s["end"]) for s in json.loads(j)]).decode("utf-8", "ignore") if j else bytes(t).decode("utf-8", "ignore") for t, j in zip(texts, listed)])

    return cut(text, spans)


def brute_force(texts: list[bytes], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """The removed runs of each text, by counting every string: for tests."""
    from collections import Counter

    count = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        at = np.array([i for i in range(len(t) - span + 1) if count[t[i : i + span]] > 1], dtype=np.int64)
        out.append(merge(at, at + span) if len(at) else [])
    return out
