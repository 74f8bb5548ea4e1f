"""Helpers the training-data operators share: working tables, row keys, sampling and batch encoding.

Row keys. ``doc_id`` may be null or repeated, so operators never assume that it identifies a row;
where rows must be found again they use ``(doc_id, digest of the text)`` compared null-safely, and
rows equal in both are interchangeable.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..plans.work import Workspace, bound_batches, delete, shared_dir

__all__ = ["Bitmap", "ChunkTable", "Workspace", "delete", "shared_dir"]

#: ``[\x20\x09-\x0D]``, the white space that the contracts name.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def text_of(column: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def through_python(rows: DataFrame, run: Callable, schema: str, id_col: str = "doc_id") -> DataFrame:
    """``mapInPandas`` with the id as text on the way, since pandas would round large ids beside nulls. The schema names the other columns."""
    bound_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType
    found = rows.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(tidied(run), f"{id_col} string, {schema}")
    return found.withColumn(id_col, F.col(id_col).cast(kind))


def free_names(frame: DataFrame, n: int) -> list[str]:
    """Column names that the frame does not have, in any case."""
    taken = {c.lower() for c in frame.columns}
    return [name for k in range(n + len(taken)) if (name := f"own_{k}") not in taken][:n]


def digest(text: Column) -> Column:
    return F.xxhash64(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, most_bytes: int | None = None) -> tuple[list[bytes], np.ndarray]:
    """At most ``per_class`` labelled training rows of each class, picked by a hash of the id, with their whole texts.

    The ids are picked first, from the labels alone, so the texts are matched by a broadcast of a
    proven size (2 * per_class ids) and the corpus is not shuffled. The number of rows is the bound that the operators use, so texts of all
    lengths have the same chance. ``most_bytes`` bounds all texts of the sample together as well, for drivers with little memory: in the order of the
    pick, a row whose text does not fit in what is left of its class's half is passed over. Of several texts of one id the shortest is taken.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out())
    rows = rows.select("doc_id", F.col(target).cast("int").alias("y"), F.xxhash64(F.lit(41), "doc_id").alias("pick")).dropDuplicates(["doc_id"])
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy("pick", "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    chosen = {r.doc_id: (r.y, r.pick) for r in picked.collect()}
    if not chosen:
        return [], np.zeros(0)

    def of_ids(ids: Iterable[int], value: Column) -> list:
        small = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "id bigint"))
        found = docs.select(F.col("doc_id").cast("bigint").alias("id"), value.alias("value")).join(small, "id")
        return [(r.id, r.value) for r in found.groupBy("id").agg(F.min("value").alias("value")).collect()]

    sizes = dict(of_ids(chosen, F.octet_length(text_of("text"))))
    half = float("inf") if most_bytes is None else most_bytes // 2
    room, ids = {0: half, 1: half}, []
    for i in sorted(sizes, key=lambda i: (chosen[i][1], i)):
        if sizes[i] <= room[chosen[i][0]]:
            room[chosen[i][0]] -= sizes[i]
            ids.append(i)
    whole = F.struct(F.octet_length(text_of("text")).alias("n"), text_of("text").cast("binary").alias("text"))
    found = sorted((i, bytes(t.text)) for i, t in of_ids(ids, whole)) if ids else []
    return [t for _, t in found], np.array([chosen[i][0] for i, _ in found], dtype=np.float64)


class Bitmap:
    """Which 64-bit keys may be in a set: a Bloom filter of two probes whose size is bounded by ``most_bits``.

    It goes to every task and saves shuffling rows that cannot match. A key of the set is never
    missed; other keys pass, 1 in 80 of them at 4 million keys, 1 in 7 at 16 million and 3 in 4 at 64 million, so results do not depend on it,
    and what it costs then is that the rows of a corpus with so many matches are shuffled.
    """

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, keys: DataFrame, most_bits: int = 1 << 26) -> Bitmap:
        """From a column ``key`` of hashes."""
        bits = min(most_bits, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
        probes = F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))
        bit = F.expr("shiftleft(1L, cast(probe % 64 as int))")
        found = keys.select(F.explode(probes).alias("probe")).groupBy(F.expr("probe div 64").alias("word")).agg(F.bit_or(bit).alias("set"))
        words = np.zeros(bits // 64, dtype=np.int64)
        rows = found.toPandas()  # at most most_bits / 64 rows
        words[rows["word"].to_numpy(dtype=np.int64)] = rows["set"].to_numpy(dtype=np.int64)
        return cls(bits, words.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64).view(np.uint64)
        out = np.ones(len(keys), dtype=bool)
        for shift in (0, 32):
            probe = (keys >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.words[probe >> np.uint64(6)] >> (probe & np.uint64(63))) & np.uint64(1) == 1
        return out


def among(bitmap: Bitmap, wanted: bool) -> Callable:
    """A test of keys: whether they may be in the bitmap's set (``wanted``), or cannot be."""

    @F.pandas_udf(BooleanType())
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(bitmap.has(keys.to_numpy()) == wanted)

    return test


class ChunkTable(dict):
    """Distinct chunk -> what was computed of it, for the chunks of one batch after another.

    ``learn`` computes the chunks that are missing, all in one call. A table that has grown past ``bound`` bytes
    (estimated) is emptied first, and chunks longer than ``longest`` go when the next batch comes, so
    memory is bounded by the table's bound and one batch, not by the corpus.
    """

    #: Bytes of an entry besides its characters and a value of bytes or text.
    ENTRY = 240

    def __init__(self, compute: Callable[[list[str]], Iterable], bound: int = 48_000_000, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.bound, self.longest, self.large, self.held = compute, bound, longest, [], 0

    def forget(self) -> None:
        self.clear()
        self.large, self.held = [], 0

    def learn(self, lists: Sequence[Sequence[str]]) -> None:
        for chunk in self.large:
            self.pop(chunk, None)
        if self.held > self.bound:
            self.forget()
        new = list(set().union(*lists).difference(self))
        self.large = [c for c in new if len(c) > self.longest]
        if new:
            self.update(zip(new, self.compute(new)))
            self.held += self.ENTRY * (len(new) - len(self.large)) + 2 * sum(map(len, new)) - 2 * sum(map(len, self.large))


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the collector of cycles, which would walk a large table of strings again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def give_back() -> None:
    """Free memory goes to the system: workers stay for the next task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back when the task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def groups(texts: Iterable[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, a longer text alone."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run
