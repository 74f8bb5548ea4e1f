"""Fill-in-the-middle transformation of texts, with a matcher that reads each text twice and stores no units.

A text is a run of units: the matches of a pattern, left to right (code points, unless another pattern is given).
The first pass counts them. Two seeded ranks are drawn from the count, and the second pass advances a lazy iterator of matches to
the smaller and on to the larger one, where it stops. No list of units, of their ends or of matches is made, so besides
the text and its output a worker holds one match at a time, however long the text is.

The prefix ends after the smaller rank's unit, the middle after the larger one's, the suffix is the rest; what no unit
covers goes to the part that it lies in. Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle), each part after its
mark, or ``plain``, the text as it is. A text that is empty or holds a mark stays plain, so outputs can be taken apart exactly:
no mark can arise where a part and a mark meet, as marks begin with ``<`` and end with ``>`` and hold neither inside.

All draws come from a hash of the seed and the id, so runs and retried tasks agree.

Defined results: null text is empty, and so plain with no units; a null id counts as empty text in the hash; repeated rows
give equal rows; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import count, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, through_python

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s)."
#: Rows whose outputs are held at once.
ROWS = 500


class Matcher:
    """Counts units and finds where given ones end, by two passes over a lazy iterator of matches."""

    def __init__(self, pattern: str = CODE_POINT) -> None:
        found = re.compile(pattern)
        if found.fullmatch(""):
            raise ValueError("a unit must not be empty")
        self._units: Callable[[str], Iterator[re.Match]] = found.finditer

    def count(self, text: str) -> int:
        number = count()
        deque(zip(self._units(text), number), maxlen=0)  # numbers are drawn only while there are units
        return next(number)

    def ends(self, text: str, ranks: tuple[int, ...]) -> Iterator[int]:
        """Where the unit of each rank ends, ranks in rising order and from 1; rank 0 ends at 0."""
        units, passed, end = self._units(text), 0, 0
        for rank in ranks:
            if rank > passed:
                end = next(islice(units, rank - passed - 1, None)).end()
                passed = rank
            yield end


def draws(seed: int, doc_id: str) -> list[int]:
    """Four unsigned 32-bit numbers from a seed and an id."""
    found = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(found[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, rate: int = 90, spm_rate: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    ``rate`` per cent of texts are cut, and of these ``spm_rate`` per cent take the form ``spm``.
    """
    matcher = Matcher(unit)
    p, s, m = MARKS

    def one(doc_id: str | None, text: str) -> tuple:
        n = matcher.count(text)
        a, b, c, d = draws(seed, doc_id or "")
        if not text or any(mark in text for mark in MARKS) or c % 100 >= rate:
            return n, "plain", None, None, text
        i, j = matcher.ends(text, tuple(sorted((a % (n + 1), b % (n + 1)))))
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if d % 100 < spm_rate:
            return n, "spm", i, j - i, "".join((s, suffix, p, prefix, m, middle))
        return n, "psm", i, j - i, "".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                rows = batch.iloc[k : k + ROWS]
                out = pd.DataFrame([one(i, t) for i, t in zip(rows["doc_id"], rows["text"])], columns=["n", "form", "prefix_chars", "middle_chars", "output"])
                out[["prefix_chars", "middle_chars"]] = out[["prefix_chars", "middle_chars"]].astype("Int64")
                out.insert(0, "doc_id", rows["doc_id"].to_numpy())
                yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return through_python(rows, run, "n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "|".join(MARKS), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
