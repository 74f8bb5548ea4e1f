"""SentencePiece encoding and decoding through a table of distinct chunks.

In this vocabulary no piece has a white-space marker after another character, so no merge crosses
from a word into the marker of the next one. A text is therefore the concatenation of chunks, each
a run of markers and the characters up to the next marker, and encoding a chunk alone gives the
ids it has in the text. Each distinct chunk is segmented once by the library and its ids are joined
back by position. ``Codec`` refuses a model for which the rule does not hold.

The table lives in the Python worker, holds chunks of at most 64 characters and is bounded in bytes;
it is emptied when full and rebuilt, so memory does not follow the corpus. (One table for the whole
cluster would need every occurrence of every word shuffled to join the ids back.)

Defined results: null text is empty and gives only the end id; marker characters in a text are what
the library makes of them (a space); repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkTable, groups, no_cycles, text_of, through_python

MARK = "▁"
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CROSSES = re.compile(f"[^{MARK}]{MARK}")


class Codec:
    """Encodes and decodes like the library, with an end id only and no sampling."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.get_piece_size()
        if any(CROSSES.search(self.library.id_to_piece(i)) for i in range(n)):
            raise ValueError("a piece crosses a white-space marker; chunks cannot be segmented alone")
        if self.library.normalize(" Ａ ") != f"{MARK}{MARK}Ａ{MARK}":
            raise ValueError("the model normalises text; chunks cannot be cut before that")
        self.end = self.library.eos_id()
        self.ids = ChunkTable(self._segment)
        #: What the library puts before each text: its own marker.
        self.prefix = MARK

    def _segment(self, chunks: list[str]) -> list[tuple[str, int, str | None]]:
        """Decimal ids, their number and the decoded text (None: just the chunk), of chunks that start with a marker."""
        # The library puts one marker in front of what it encodes, so it gets each chunk without its first one.
        ids = self.library.encode([c[1:] for c in chunks], num_threads=1)
        alone = [self.library.piece_to_id(MARK)]
        ids = [found or alone for found in ids]
        texts = self.library.decode(ids, num_threads=1)
        return [(" ".join(map(str, i)), len(i), None if t == c[1:].replace(MARK, " ") else t) for c, i, t in zip(chunks, ids, texts)]

    def chunks(self, text: str) -> list[str]:
        return CHUNKS.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        self.ids.learn([chunks])
        return [int(i) for c in chunks for i in self.ids[c][0].split()] + [self.end]

    def summaries(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the decoded text, of each text."""
        for run in groups(texts):
            cut = [self.chunks(text) for text in run]
            self.ids.learn(cut)
            for text, chunks in zip(run, cut):
                found = list(map(self.ids.__getitem__, chunks))
                ids = " ".join([f[0] for f in found] + [str(self.end)])
                if any([f[2] is not None for f in found]):
                    # decode() drops the first marker of a text; alone, each chunk has lost its own, which stands for a space.
                    text = " ".join([c[1:] if f[2] is None else f[2] for c, f in zip(chunks, found)])
                decoded = text.replace(MARK, " ")
                yield sum([f[1] for f in found]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=1)
def codec(model: str) -> Codec:
    """The codec of this Python worker; its table serves one task after another."""
    return Codec(model)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with no_cycles():
            for batch in batches:
                found = list(codec(model).summaries(batch["text"]))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [f[0] for f in found], "ids_sha256": [f[1] for f in found], "decoded_sha256": [f[2] for f in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return through_python(rows, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and the ids themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [codec(model).encode(t) for t in batch["text"]]})

    return through_python(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), run, "ids array<int>")
