"""Near-duplicate groups by an inverted join on signature coordinates.

Documents with the same set of word shingles are one class from the start. Each class has a MinHash signature of
``K`` = 64 coordinates, and each coordinate with its value is a token. A pair of classes with similarity
of 0.75 agrees on 48 coordinates on average, and on fewer than ``MATCH`` = 30 once in about 2,600,000 pairs
(less similar still, or linked by way of others, far more rarely missed), so pairs that agree on ``MATCH`` are candidates:

* Prefix: with tokens in order of how many classes have them, two classes that share ``MATCH`` tokens
  share one of the ``PREFIX = K - MATCH + 1`` rarest of either. Only those are posted; tokens of
  passages that many documents share are at the end of the order and are not posted.
* Skip: the long lists behind the prefix are never merged; a pair's full signatures are compared instead,
  inside the join on posting lists and at the pair's first common token only, so each candidate comes out once.
* Pairs above the match threshold are confirmed on full shingle sets, exactly.

No group is expanded into all its pairs. Each class is first tested against the most central class (hub) of its posting
lists: the original of a group of edited copies has the most widely shared tokens. What is linked becomes one component.
For the rest, what the test against the hub found is used again: with x and y of h's group, their symmetric differences
to h of e and f shingles (d missing and a added, d' and a'), o of them in common, a link of x and y means

    7 o >= 4 (d + d') + 3 (a + a') - h,

and if x is not linked with h, so that 4 d + 3 a > h, then o > (4 d' + 3 a') / 7: more than three sevenths of what sets y
apart from the hub sets x apart too. So classes that are not linked with their hub are joined with their
group on the shingles of these differences: of y only the rarest, as many as must hold a common one, and of a pair
only if bitmaps of the differences allow enough in common.

Classes that share tokens without a common hub, as documents with a long passage in common and a text of their own do, are
candidates only if they can be linked: their shingles are put in order of how many of these classes have them, and with o common shingles of x and of y, not
larger than x, a link means o >= 6/7 |y| and o >= 3/4 |x|. So one of the |y| div 7 + 1 rarest of y is among the |x| div 4 + 1
rarest of x. Shingles of its own come first in that order and are in no list, so a class with a seventh of its text to itself is posted
nowhere as the smaller one. Pairs that meet there are compared by signatures, as above.
Components, links and signatures stay in tables. Classes are named by 128 bits of a cryptographic hash of their set of
64-bit shingle hashes.

Defined results: null text is empty; texts without words have an empty set and are linked with nothing;
texts of fewer than five words have one shingle; rows with equal sets, repeated rows included, are one component;
``component_id`` is the smallest id that is not null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from .common import ASCII_SPACE, Bitmap, Workspace, free_names, text_of, through_python, tidied
from .rolling import Base, Rolling, mix

WORDS = 5
K = 64
MATCH = 30
PREFIX = K - MATCH + 1
#: Words of 64 bits in the bitmap of a difference.
MAP = 8
BLOCK = 1 << 18

_random = np.random.default_rng(20240229)
_STEPS = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _random.integers(1, 2**63, WORDS, dtype=np.uint64)
_COORDINATES = _random.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MARKS = _random.integers(1, 2**63, K, dtype=np.uint64)
_BASE = Base(303)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=np.int8)
_SPACE[list(ASCII_SPACE)] = 1


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in bytes."""
    space = np.ones(len(data) + 2, dtype=np.int8)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[0::2], edges[1::2]
    return Rolling(_LOWER[data], _BASE).of(starts, ends), starts


def _blocks(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    at = 0
    while len(text) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(text) and text[cut] not in ASCII_SPACE:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _shingles(words: np.ndarray) -> np.ndarray:
    n = len(words) - WORDS + 1
    total = words[:n] * _STEPS[0]
    for k in range(1, WORDS):
        total += words[k : n + k] * _STEPS[k]
    return total


def shingle_sets(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > BLOCK:
            yield from _sets(run)
            run, size = [], 0
        run.append(text)
        size += len(text) + 1
    yield from _sets(run)


def _sets(run: list[bytes]) -> Iterator[np.ndarray]:
    if len(run) == 1:
        parts = [word_hashes(np.frombuffer(b, dtype=np.uint8))[0] for b in _blocks(run[0])]
        words, cuts = np.concatenate(parts), np.array([0, sum(map(len, parts))])
    elif run:
        words, starts = word_hashes(np.frombuffer(b" ".join(run), dtype=np.uint8))
        cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in run]))))
    else:
        return
    shingles = mix(_shingles(words)) if len(words) >= WORDS else np.zeros(0, dtype=np.uint64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= WORDS:
            found = np.sort(shingles[a : b - WORDS + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            yield mix((words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHORT[b - a])
        else:
            yield shingles[:0]


def signature(found: np.ndarray) -> np.ndarray:
    """A token for each coordinate: its smallest hash over the set, marked with the coordinate."""
    low = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(low, (found[at : at + 4096, None] * _COORDINATES).min(0), out=low)
    return mix(low ^ _MARKS).view(np.int64)


def class_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("at"), text.cast("binary").alias("text"))


def _signatures(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, classes, tokens = [], [], []
            for found in shingle_sets(batch["text"]):
                sizes.append(len(found))
                classes.append(class_of(found))
                tokens.append(signature(found) if len(found) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "at": batch["at"], "n_shingles": sizes, "cid": classes, "tokens": tokens})

    return through_python(rows, run, "at long, n_shingles long, cid binary, tokens array<long>")


def _full_sets(rows: DataFrame, wanted: Bitmap) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[wanted.has(batch["at"].to_numpy())]
            sets = list(shingle_sets(batch["text"]))
            yield pd.DataFrame({"cid": [class_of(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return rows.select("at", "text").mapInPandas(tidied(run), "cid binary, shingles binary").where("cid is not null")


def _linked(x: np.ndarray, y: np.ndarray, both: int) -> bool:
    return 100 * both >= 75 * (len(x) + len(y) - both)


@F.pandas_udf(BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        out.append(_linked(x, y, len(np.intersect1d(x, y, assume_unique=True))))
    return pd.Series(out, dtype=bool)


DIFFERENCE = StructType().add("linked", BooleanType())
for _name in ("h", "missing", "added"):
    DIFFERENCE = DIFFERENCE.add(_name, LongType())
for _name in ("items", "map"):
    DIFFERENCE = DIFFERENCE.add(_name, ArrayType(LongType()))


@F.pandas_udf(DIFFERENCE)
def _difference(a: pd.Series, b: pd.Series, group: pd.Series) -> pd.DataFrame:
    """Whether a class is linked with a hub; for its group's hub also the symmetric difference, with a bitmap."""
    out = []
    for x, y, wide in zip(a, b, group):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        apart = np.setxor1d(x, y, assume_unique=True)
        both = (len(x) + len(y) - len(apart)) // 2
        if wide:
            bit = apart % np.uint64(64 * MAP)
            marks = np.zeros(64 * MAP, dtype=np.uint8)
            marks[bit.astype(np.int64)] = 1
            marks = np.packbits(marks, bitorder="little").view(np.int64)
        out.append((_linked(x, y, both), len(y), len(y) - both, len(x) - both, apart.view(np.int64) if wide else None, marks if wide else None))
    return pd.DataFrame(out, columns=["linked", "h", "missing", "added", "items", "map"])


class NearDuplicates:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.space = Workspace(docs.sparkSession, "minhash")
        self.source = _rows(docs, id_col, text_col)
        self.rows = self.space.table(_signatures(self.source), "rows")
        classes = self.rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.min("at").alias("at"), F.first("tokens").alias("tokens"))
        self.classes = self.space.table(classes, "classes")

    def postings(self) -> DataFrame:
        """(cid, posted, central): each class's prefix, where others have its tokens too, and how widely its tokens are shared."""
        tokens = self.classes.select("cid", F.explode("tokens").alias("token"))
        spread = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        shared = tokens.join(spread, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"), F.sum("df").alias("central"))
        room = F.lit(PREFIX - K) + F.size("shared")
        posted = F.slice("shared", F.lit(1), room)["token"]
        return self.space.table(shared.where(room > 0).select("cid", posted.alias("posted"), "central"), "postings")

    def _with_sets(self, pairs: DataFrame) -> DataFrame:
        own = self.sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
        hub = self.sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(own, "a").join(hub, "b")

    def confirm(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs that are linked, by their full sets."""
        checked = self._with_sets(pairs.select("a", "b")).select("a", "b", _similar("sa", "sb").alias("linked"))
        return self.space.table(checked, label).where("linked")

    def solve(self) -> DataFrame:
        """(cid, comp): the component of each class that another class might be linked with."""
        members = self.postings().join(self.classes.select("cid", "at", "tokens"), "cid")
        members = self.space.table(members, "members")
        wanted = Bitmap.of(members.select(F.col("at").alias("key")))
        found = _full_sets(self.source, wanted).groupBy("cid").agg(F.first("shingles").alias("shingles"))
        self.sets = self.space.table(found.join(members.select("cid"), "cid", "left_semi"), "sets")
        labels = members.select("cid", F.col("cid").alias("comp"))

        tested = self.against_hubs(members)
        labels = self.space.table(merge(self.space, labels, tested.where("linked").select("a", "b")), "labels")
        group = tested.where("group").select(F.col("a").alias("cid"), F.col("b").alias("hub"), "linked", "h", "missing", "added", "items", "map")

        links = self.confirm(self.within_groups(group, labels), "differences")
        labels = self.space.table(merge(self.space, labels, links), "labels")
        links = self.confirm(self.between_groups(members, group, labels), "signatures")
        return self.space.table(merge(self.space, labels, links), "labels")

    def against_hubs(self, members: DataFrame) -> DataFrame:
        """Each class against two hubs of its lists, if it agrees with them: the one it agrees with most, and the most central one, its group's."""
        lists = members.select(F.explode("posted").alias("token"), "cid", "central")
        hubs = lists.groupBy("token").agg(F.max(F.struct("central", "cid")).alias("hub"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("low != high")
        pairs = lists.join(hubs.select("token", F.col("hub.cid").alias("b"), F.col("hub.central").alias("weight")), "token").where("cid != b")
        pairs = pairs.groupBy(F.col("cid").alias("a"), "b").agg(F.max("weight").alias("weight"))
        pairs = pairs.join(members.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a").join(members.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
        pairs = pairs.select("a", "b", "weight", F.size(F.array_intersect("ta", "tb")).alias("agree")).where(F.col("agree") >= MATCH)
        two = pairs.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("likely"), F.max(F.struct("weight", "b")).alias("central"))
        one = F.struct(F.col("central.b").alias("b"), F.lit(True).alias("group"))
        other = F.struct(F.col("likely.b").alias("b"), F.lit(False).alias("group"))
        two = two.select("a", F.explode(F.when(F.col("likely.b") == F.col("central.b"), F.array(one)).otherwise(F.array(one, other))).alias("p")).select("a", "p.b", "p.group")
        checked = self._with_sets(two).select("a", "b", "group", _difference("sa", "sb", "group").alias("found"))
        return self.space.table(checked.select("a", "b", "group", "found.*"), "hubs")

    def within_groups(self, group: DataFrame, labels: DataFrame) -> DataFrame:
        """(a, b): pairs of one group and different components whose differences to the hub may have enough in common; a is not linked with the hub."""
        cells = [F.col("map")[k].alias(f"m{k}") for k in range(MAP)]
        size = F.col("missing") + F.col("added")
        rows = group.join(labels, "cid").join(group.where("not linked").select("hub").distinct(), "hub", "left_semi")
        rows = self.space.table(rows.select("hub", "cid", "comp", "linked", "h", size.alias("size"), (4 * F.col("missing") + 3 * F.col("added")).alias("weight"), "items", *cells), "groups")
        light = ["cid", "comp", "linked", "h", "size", "weight", *[f"m{k}" for k in range(MAP)]]
        outside = rows.where("not linked").select("hub", F.explode("items").alias("item"), *light)
        held = outside.groupBy("hub", "item").agg(F.count("*").alias("n"))
        posted = rows.select("hub", "cid", "size", "weight", F.explode("items").alias("item")).join(held, ["hub", "item"], "left")
        posted = posted.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item"))).alias("rare"), F.first("size").alias("size"), F.first("weight").alias("weight"))
        # Of ``size`` items at least (weight + 1) / 7 are common ones.
        prefix = F.slice("rare", F.lit(1), (F.col("size") - F.expr("(weight + 7) div 7") + 1).cast("int"))
        posted = posted.select("cid", F.explode(F.filter(prefix, lambda r: r["n"] > 0)["item"]).alias("item")).join(rows.select("hub", *light), "cid")
        x, y = outside.alias("x"), posted.alias("y")

        def only(one: str, other: str) -> Column:
            """Items that bitmaps prove to be in one difference only."""
            return sum((F.bit_count(F.col(f"{one}.m{k}").bitwiseAND(F.bitwise_not(F.col(f"{other}.m{k}")))) for k in range(1, MAP)), F.bit_count(F.col(f"{one}.m0").bitwiseAND(F.bitwise_not(F.col(f"{other}.m0")))))

        most = F.least(F.col("x.size") - only("x", "y"), F.col("y.size") - only("y", "x"))
        once = F.col("y.linked") | (F.col("x.cid") < F.col("y.cid"))
        near = 7 * most >= F.col("x.weight") + F.col("y.weight") - F.col("x.h")
        on = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.comp") != F.col("y.comp")) & once & near
        return x.join(y, on).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()

    def between_groups(self, members: DataFrame, group: DataFrame, labels: DataFrame) -> DataFrame:
        """(a, b): pairs of different components without a common hub that agree on ``MATCH`` coordinates, each once."""
        lists = members.select("cid", F.explode("posted").alias("token")).join(labels, "cid").join(group.select("cid", "hub"), "cid", "left")
        mixed = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("hub").alias("one"), F.max("hub").alias("other"), F.bool_or(F.col("hub").isNull()).alias("without"))
        mixed = mixed.where("low != high and (without or one != other)").select("token")
        some = self.space.table(lists.join(mixed, "token", "left_semi").select("cid", "comp", "hub").distinct(), "mixed")
        rows = self.space.table(self.rarest(some), "rarest")
        shared = rows.groupBy("item").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("item")
        rows = self.space.table(rows.join(shared, "item", "left_semi"), "posted")
        x, y = rows.alias("x"), rows.where("at <= n div 7").alias("y")
        smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.cid") < F.col("x.cid")))
        apart = (F.col("x.comp") != F.col("y.comp")) & ~F.coalesce(F.col("x.hub") == F.col("y.hub"), F.lit(False))
        # What is common lies behind the first common one in both orders.
        most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
        near = (4 * F.col("y.n") >= 3 * F.col("x.n")) & (7 * most >= 3 * (F.col("x.n") + F.col("y.n")))
        pairs = x.join(y, (F.col("x.item") == F.col("y.item")) & smaller & apart & near).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
        own, other = (members.select(F.col("cid").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
        return pairs.join(own, "a").join(other, "b").where(F.size(F.array_intersect("ta", "tb")) >= MATCH).select("a", "b")

    def rarest(self, classes: DataFrame) -> DataFrame:
        """(item, at, n, cid, comp, hub): of the n shingles of each class the n div 4 + 1 rarest among these classes, as far as others have them, with their places."""

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for cid, shingles in zip(batch["cid"], batch["shingles"]):
                    found = np.frombuffer(shingles, dtype=np.int64)
                    yield pd.DataFrame({"cid": [cid] * len(found), "n": len(found), "item": found})

        items = self.sets.join(classes.select("cid"), "cid", "left_semi").mapInPandas(tidied(listed), "cid binary, n long, item long")
        held = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
        order = F.sort_array(F.collect_list(F.struct("df", "item")))["item"].alias("items")  # a class's own set
        rare = items.join(held, "item").groupBy("cid", "n").agg(order).withColumn("first", F.col("n") - F.size("items"))
        room = F.greatest(F.lit(0), F.expr("n div 4 + 1 - first").cast("int"))
        rare = rare.select("cid", "n", "first", F.posexplode(F.slice("items", F.lit(1), room)).alias("k", "item"))
        return rare.join(classes, "cid").select("item", (F.col("first") + F.col("k")).alias("at"), "n", "cid", "comp", "hub")

    def result(self) -> DataFrame:
        labels = self.solve()
        linked = self.classes.select("cid", "first_id").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        least = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
        names = self.space.table(linked.join(least, "comp").select("cid", "component_id"), "names")
        out = self.rows.select("doc_id", "n_shingles", "cid", "at").join(names, "cid", "left")
        out = out.withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "at")


def merge(space: Workspace, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links joined their components: smallest label over neighbours, then labels of labels, until nothing changes."""
    edges = links.join(labels.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b")
    edges = edges.select("ca", "cb").distinct()
    edges = space.table(edges.union(edges.select("cb", "ca")).distinct().toDF("from", "to"), "edges")
    if edges.isEmpty():
        return labels
    now = space.table(edges.groupBy("from").agg(F.min("to").alias("low")).select(F.col("from").alias("node"), F.least("from", "low").alias("label")), "nodes")
    while True:
        low = edges.join(now, F.col("to") == F.col("node")).groupBy("from").agg(F.min("label").alias("low"))
        step = now.join(low, F.col("node") == F.col("from")).select("node", F.least("label", "low").alias("next"), F.col("label").alias("was"))
        jump = now.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        step = step.join(jump, F.col("next") == F.col("at"), "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), "was")
        done = space.table(step, "nodes")
        changed = not done.where("label != was").isEmpty()
        space.drop(now)
        now = done.select("node", "label")
        now._tarmac_path = done._tarmac_path
        if not changed:
            break
    return labels.join(now, F.col("comp") == F.col("node"), "left").select("cid", F.coalesce("label", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, at (hash of id and text)."""
    return NearDuplicates(docs, id_col, text_col).result()


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document that stays of each component, with all its columns; of repeated rows one."""
    own, at, kept_id = free_names(docs, 3)
    found = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("at").alias(at), F.col("doc_id").alias(kept_id)).distinct()
    rows = docs.withColumn(own, F.xxhash64(F.col(id_col), text_of(text_col)))
    joined = rows.join(found, (F.col(own) == F.col(at)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(kept_id)))
    return joined.dropDuplicates([at, kept_id]).select(*[joined[c] for c in docs.columns])
