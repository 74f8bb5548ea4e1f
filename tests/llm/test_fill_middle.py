"""Fill-in-the-middle against slices of lists."""

from __future__ import annotations

import random
import re
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.llm import fill_middle as fim

SCHEMA = "doc_id long, text string, n int, FORM string, Output string, own_0 int"


def cut(doc_id, text, unit=fim.CODE_POINT, seed=1, rate=90, spm_rate=20):
    text = text or ""
    units = list(re.finditer(unit, text))
    n, (a, b, c, d) = len(units), fim.draws(seed, "" if doc_id is None else str(doc_id))
    if not text or any(m in text for m in fim.MARKS) or c % 100 >= rate:
        return n, "plain", None, None, text
    i, j = (0 if k == 0 else units[k - 1].end() for k in sorted((a % (n + 1), b % (n + 1))))
    form = "spm" if d % 100 < spm_rate else "psm"
    return n, form, i, j - i, f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}" if form == "spm" else f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"


def texts():
    rng = random.Random(3)
    some = ["", None, "a", "é", "\U0001f600" * 5, "line\nline\r\n", "<P", "S>", "<M>", "a<S>b", "<<<", "<P<S<M>", "\x00\x00", "x" * 70_000]
    return some + ["".join(rng.choice("ab <>PSM\n\U0001f600é") for _ in range(rng.randrange(60))) for _ in range(300)]


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\S+\s*", r"[^\n]*\n|[^\n]+$"])
def test_every_text_is_cut_and_restored(spark, unit):
    rows = [(None if k % 50 == 1 else 2**53 + k, t, 1, "f", "o", 2) for k, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = fim.transform(df, unit, rate=80, spm_rate=50).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(r[0], *cut(r[0], r[1], unit, rate=80, spm_rate=50), r[1] or "") for r in rows], key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n<>PSM\U0001f600", max_size=40), st.lists(st.integers(0, 40), min_size=2, max_size=2))
def test_two_passes_equal_a_list(text, ranks):
    for unit in (fim.CODE_POINT, r"\w+"):
        found = list(re.finditer(unit, text))
        matcher = fim.Matcher(unit)
        assert matcher.count(text) == len(found)
        ranks = sorted(r % (len(found) + 1) for r in ranks)
        assert list(matcher.ends(text, tuple(ranks))) == [0 if r == 0 else found[r - 1].end() for r in ranks]


def test_memory_does_not_follow_the_units():
    matcher, text = fim.Matcher(), "ab" * 500_000
    tracemalloc.start()
    assert matcher.count(text) == 1_000_000 and list(matcher.ends(text, (10, 900_000))) == [10, 900_000]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000


def test_empty_units_are_refused():
    with pytest.raises(ValueError):
        fim.Matcher(r"\w*")
