"""Approximate nearest neighbours with balanced posting lists.

* Centroids come from a sample that grows with the table up to ``SAMPLE`` vectors, cut in halves again and again at
  the median along the line between two means, so that each leaf holds equally many sample vectors, then moved to
  the means of the vectors nearest to them.
  So the number of lists grows with the table, up to ``SAMPLE / LEAF`` (21,845) or what the sample's bytes allow, some 2 million vectors of 64
  dimensions; beyond that lists grow with the table, and a query reads the same share of it.
* Centroids are searched by an in-memory graph (near neighbours and a few far links, best first).
* Every vector is indexed. It is posted to its nearest list and, near a boundary, to others whose centroid is
  nearly as near. How near is fitted on a second sample so that ``BOUNDARY`` of the vectors have a second list.
* A query reads all lists whose centroid is within a ratio of the nearest one's distance. The ratio is fitted: for vectors
  of the second sample, their neighbours in it are found exactly, and the ratio is what reaches ``REACH`` of
  them. No number of lists is fixed: clustered vectors need few, vectors without structure many.
* Ratios are fitted on all rows and may suit few of them, so what the lists read leave out is checked: a list whose centroid is farther than its own radius
  and the distance of the query's last result together holds nothing nearer; all other lists are read too.
* ``SHELF`` lists are read together, so that a query sends its vector and gets its nearest ones once for all of them that it reads. A shelf of
  more than ``PART_ROWS`` rows is cut into parts, and its queries into blocks of ``BLOCK``; each pair of a part
  and a block is one group, so no task holds more than that.

Equal vectors are one entry with the ``k + 1`` smallest ids, all that a search can return of them, so a
vector that a third of the rows share costs one entry. Distances are computed in double precision
on the original vectors, and results are exact; with ``checked`` off they are so within the lists of the ratio, and ``recall`` measures what that misses.
With ``exactly`` every query reads every list, in the same blocks.

Defined results: vectors that are null, zero, of another length than most, or with a null or
non-finite component take no part, as query or candidate; fewer candidates than ``k`` are all returned if their lists
are read (always so below ``LIST_ROWS`` vectors, which are one list); repeated rows (same id and vector) are one row; null ids
take no part; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Most vectors of the sample that the index is fitted on, sample vectors for each centroid, rows of a part of a shelf, queries of a block, lists of a shelf.
SAMPLE = 1 << 18
LEAF = 12
#: Most bytes of the sample, which comes to the driver as float32.
SAMPLE_BYTES = 64 << 20
PART_ROWS = 4096
BLOCK = 1024
SHELF = 16
#: Fewer vectors than this are one list.
FEW = 512
#: Vectors that a list is meant to hold, before boundary vectors are replicated.
TARGET = 96
#: Most lists of a vector, and the share of vectors that have more than one.
REPLICAS = 3
BOUNDARY = 0.3
#: Share of true neighbours that the lists read must hold, among how many vectors that is fitted, and for how many of them.
REACH = 0.95
APART = 4096
MEASURED = 256


def halve(sample: np.ndarray, leaves: int, seed: int = 11) -> np.ndarray:
    """Centroids of about ``leaves`` equally filled leaves."""
    random = np.random.default_rng(seed)
    parts = [sample]
    while len(parts) < leaves and max(map(len, parts)) > 1:
        parts.sort(key=len)
        part = parts.pop()
        two = part[random.choice(len(part), 2, replace=False)].copy()
        for _ in range(6):
            nearer = ((part - two[0]) ** 2).sum(1) <= ((part - two[1]) ** 2).sum(1)
            if nearer.all() or not nearer.any():
                break
            two[0], two[1] = part[nearer].mean(0), part[~nearer].mean(0)
        order = np.argsort((part @ (two[1] - two[0])), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return np.unique(np.stack([p.mean(0) for p in parts]), axis=0)


class Graph:
    """Neighbours of each centroid, searched best-first for many vectors at once."""

    def __init__(self, points: np.ndarray, near: int = 14, far: int = 4, seed: int = 13) -> None:
        self.points = np.ascontiguousarray(points, dtype=np.float32)
        n = len(points)
        random = np.random.default_rng(seed)
        near = min(near, n - 1)
        links = np.zeros((n, near + far), dtype=np.int32)
        squares = (self.points**2).sum(1)
        for at in range(0, n, 1024):
            d = squares[at : at + 1024, None] + squares - 2 * self.points[at : at + 1024] @ self.points.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            if near:
                links[at : at + len(d), :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        links[:, near:] = random.integers(0, n, (n, far))
        self.links = links
        self.entries = random.choice(n, min(n, 16), replace=False)

    def search(self, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids nearest to each vector, nearest first, and their distances."""
        most = min(most, len(self.points))
        out = [self._search(vectors[at : at + 256].astype(np.float32), most, 1.0) for at in range(0, len(vectors), 256)]
        return np.vstack([o[0][:, :most] for o in out]), np.vstack([o[1][:, :most] for o in out])

    def within(self, vectors: np.ndarray, ratio: float) -> list[np.ndarray]:
        """All centroids within a ratio of the nearest one's distance, as far as the graph leads to them."""
        out: list[np.ndarray] = []
        for at in range(0, len(vectors), 64):
            ids, dist = self._search(vectors[at : at + 64].astype(np.float32), 1, ratio)
            out += [i[d <= ratio * d[0] + 1e-6] for i, d in zip(ids, dist)]
        return out

    def _search(self, x: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(self.points), np.arange(len(x))[:, None]
        beam = min(n, most + 16)
        seen = np.zeros((len(x), n), dtype=bool)
        ids = np.tile(self.entries, (len(x), 1))
        seen[rows, ids] = True
        dist = ((self.points[ids] - x[:, None]) ** 2).sum(2)
        done = np.zeros(ids.shape, dtype=bool)
        while True:
            order = np.argsort(dist, axis=1)
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            # Followed are the nearest ones and all within the ratio.
            wanted = (dist <= dist[:, :1] * ratio**2 + 1e-6) & (ratio > 1.0)
            wanted[:, :beam] = True
            wanted &= np.isfinite(dist)
            keep = max(beam, int(wanted.sum(1).max()))
            ids, dist, done, wanted = ids[:, :keep], dist[:, :keep], done[:, :keep], wanted[:, :keep]
            todo = ~done & wanted
            if not todo.any():
                return ids, np.sqrt(np.maximum(dist, 0))
            # The best few of each row that were not followed yet.
            rank = np.where(todo, np.arange(dist.shape[1]), dist.shape[1])
            pick = np.sort(rank, axis=1)[:, : 4 if ratio == 1.0 else 16]
            use = pick < dist.shape[1]
            pick = np.minimum(pick, dist.shape[1] - 1)
            r, c = np.nonzero(use)
            done[r, pick[r, c]] = True
            found = np.where(use[:, :, None], self.links[ids[rows, pick]], ids[:, :1, None]).reshape(len(x), -1)
            found.sort(axis=1)
            fresh = ~seen[rows, found]
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            seen[rows, found] = True
            r, c = np.nonzero(fresh)
            new = np.full(found.shape, np.inf, dtype=np.float32)
            new[r, c] = ((self.points[found[r, c]] - x[r]) ** 2).sum(1)
            ids, dist = np.hstack([ids, found]), np.hstack([dist, new])
            done = np.hstack([done, np.zeros(found.shape, dtype=bool)])


def settle(sample: np.ndarray, centroids: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Centroids moved to the means of what is nearest to them; halves that cut through a cluster let go of it."""
    for _ in range(rounds):
        near = Graph(centroids).search(sample, 1)[0][:, 0]
        n = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(sample[order], (np.cumsum(n) - n)[n > 0], axis=0)
        centroids = np.vstack([sums / n[n > 0, None], centroids[n == 0]])
    return np.unique(centroids, axis=0)


class Index:
    """Centroids and the two fitted ratios."""

    def __init__(self, sample: np.ndarray, apart: np.ndarray, lists: int, k: int, total: int) -> None:
        self.graph = Graph(settle(sample, halve(sample, lists)) if len(sample) else np.zeros((1, 1)))
        self.replica_ratio = self.probe_ratio = 1.0
        if len(self.graph.points) > 1:
            # Ratios are fitted on vectors that the centroids were not fitted on, which lie farther from them.
            apart = apart if len(apart) > 1 else sample
            _, near = self.graph.search(apart, 2)
            self.replica_ratio = float(np.quantile(near[:, 1] / np.maximum(near[:, 0], 1e-12), BOUNDARY))
            # So many neighbours among these lie about as far as k in the whole table.
            self.probe_ratio = self._reach(apart, max(1, -(-k * len(apart) // max(1, total))))

    def _reach(self, sample: np.ndarray, k: int) -> float:
        """The ratio of centroid distances that leads the first vectors to ``REACH`` of their neighbours in it."""
        n = len(sample)
        lists = self.post(sample)
        width = max(map(len, lists))
        lists = np.array([row + row[:1] * (width - len(row)) for row in lists])
        asked, squares = sample[: min(n, MEASURED)], (sample**2).sum(1)
        to_lists = np.sqrt(np.maximum((asked**2).sum(1)[:, None] + (self.graph.points.astype(np.float64) ** 2).sum(1) - 2 * asked @ self.graph.points.T, 0))
        needed = []
        for q in range(len(asked)):
            d = squares - 2 * sample @ asked[q]
            d[q] = np.inf
            near = np.argpartition(d, min(k, n - 1) - 1)[: min(k, n - 1)]
            needed.append(to_lists[q][lists[near]].min(1) / max(to_lists[q].min(), 1e-12))
        return float(np.quantile(np.concatenate(needed), REACH))

    def post(self, vectors: np.ndarray) -> list[list[int]]:
        """Lists of each vector: the nearest, and across boundaries others that are nearly as near."""
        ids, dist = self.graph.search(vectors, REPLICAS)
        inside = dist <= self.replica_ratio * dist[:, :1]
        inside[:, 0] = True
        return [row[ok].tolist() for row, ok in zip(ids, inside)]

    def probe(self, vectors: np.ndarray) -> list[list[int]]:
        return [row.tolist() for row in self.graph.within(vectors, self.probe_ratio)]


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col(id_col).isNotNull() & v.isNotNull()).where(sound & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"))


def _best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest rows of each query; the limit applies before the shuffle."""
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("q", "vec_id", "score")


def _read(postings: DataFrame, questions: DataFrame, k: int, space: Workspace) -> DataFrame:
    """(q, vec_id, score) of the ``k + 1`` nearest in the lists of ``questions(q, v, shelf, lists)``."""
    cut = [F.ceil(F.col(n) / F.lit(size)).cast("int").alias(c) for n, size, c in (("n", PART_ROWS, "parts"), ("m", BLOCK, "blocks"))]
    sizes = postings.groupBy("shelf").agg(F.count("*").alias("n")).join(questions.groupBy("shelf").agg(F.count("*").alias("m")), "shelf")
    sizes = space.table(sizes.select("shelf", *cut), "sizes")

    def every_one(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def some(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    postings = postings.join(sizes, "shelf").select("entry", "ids", "v", "list", "shelf", some("entry", "parts").alias("part"), every_one("blocks").alias("block"))
    questions = questions.join(sizes, "shelf").select("q", "v", "lists", "shelf", every_one("parts").alias("part"), some("q", "blocks").alias("block"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "vec_id": [], "score": []}).astype({"q": np.int64, "vec_id": np.int64, "score": np.float64})
        # Each vector once, with marks of its lists in the shelf.
        first, row = np.unique(right["entry"].to_numpy(), return_index=True, return_inverse=True)[1:]
        marks = np.zeros((len(first), SHELF), dtype=np.float32)
        marks[row, right["list"].to_numpy() % SHELF] = 1
        own = np.stack(right["v"].to_numpy()[first])
        ids = right["ids"].to_numpy()[first]
        squares = (own**2).sum(1)
        out = []
        for at in range(0, len(left), 128):
            some = left.iloc[at : at + 128]
            asked = np.stack(some["v"].to_numpy())
            wanted = np.zeros((len(some), SHELF), dtype=np.float32)
            for i, lists in enumerate(some["lists"]):
                wanted[i, np.asarray(lists) % SHELF] = 1
            here = wanted @ marks.T > 0
            # Products pick what may be among the nearest, within their rounding; the measure itself is of those alone.
            own_squares = (asked**2).sum(1)
            rough = squares + own_squares[:, None] - 2 * asked @ own.T
            slack = 1e-12 * (squares.max() + own_squares) + 1e-300
            rough[~here] = np.inf
            last = np.partition(rough, min(k, len(own) - 1), axis=1)[:, min(k, len(own) - 1)]
            for i, q in enumerate(some["q"]):
                near = np.flatnonzero(here[i] & ~(rough[i] > last[i] + 2 * slack[i]))
                d = np.sqrt(((own[near] - asked[i]) ** 2).sum(1))
                found = sorted((x, n) for x, j in zip(d.tolist(), near) for n in ids[j])[: k + 1]
                out.append(pd.DataFrame({"q": q, "vec_id": [n for _, n in found], "score": [x for x, _ in found]}).astype({"vec_id": np.int64, "score": np.float64}))
        return pd.concat(out) if out else compare(left[:0], right)

    key = ["shelf", "part", "block"]
    found = questions.groupBy(*key).cogroup(postings.groupBy(*key)).applyInPandas(compare, "q long, vec_id long, score double")
    # A row comes from as many shelves as its vector has lists, so so many rows hold the k + 1 nearest.
    found = _best(found, (k + 1) * REPLICAS).groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    return _best(found, k + 1)


def nearest(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", exactly: bool = False, checked: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    space = Workspace(spark, "ann")
    rows = valid(rows, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common.n if common else 0)).withColumn("h", F.xxhash64("v"))

    # Equal vectors are one entry, with the k + 1 smallest ids; the group limit applies before the shuffle.
    ordered = Window.partitionBy("h", "v").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "h"]).withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= k + 1)
    entries = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.element_at("ids", 1))
    entries = space.table(entries, "entries")
    asked = space.table(rows.where(F.col("vec_id") % every == 0).select("vec_id", "h").dropDuplicates(), "asked")

    total = entries.count()
    wide = common.n if common else 1
    lists = max(1, min(total // TARGET, min(SAMPLE, SAMPLE_BYTES // (4 * wide)) // LEAF))
    lists = lists if total > FEW else 1
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(lists * LEAF + APART).select(F.col("v").cast("array<float>").alias("v")).toArrow()
    sample = sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, wide)
    index = spark.sparkContext.broadcast(Index(sample[: lists * LEAF], sample[lists * LEAF :], lists, k, total))

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["v"].to_numpy())
                lists = index.value.post(vectors)
                far = np.sqrt(((index.value.graph.points[[row[0] for row in lists]].astype(np.float64) - vectors) ** 2).sum(1))
                # Its own list has the vector within its radius; others have it too.
                batch = batch.assign(list=lists, far=[[d, *[0.0] * (len(row) - 1)] for d, row in zip(far, lists)])
                yield batch.explode(["list", "far"]).astype({"list": np.int64, "far": np.float64})

    def shelved(asked: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        out = []
        for q, v, lists in asked:
            lists = np.sort(np.asarray(lists, dtype=np.int64))
            for part in np.split(lists, np.flatnonzero(np.diff(lists // SHELF)) + 1) if len(lists) else ():
                out.append((q, v, int(part[0]) // SHELF, part))
        return pd.DataFrame(out, columns=["q", "v", "shelf", "lists"])

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                read = [np.arange(len(index.value.graph.points))] * len(batch) if exactly else index.value.probe(np.stack(batch["v"].to_numpy()))
                yield shelved(list(zip(batch["q"], batch["v"], read)))

    entry = "entry long, ids array<long>, v array<double>"
    postings = space.table(entries.select("entry", "ids", "v").mapInPandas(posted, f"{entry}, list long, far double"), "postings")
    distinct = asked.select("h").distinct()
    vectors = space.table(entries.join(distinct, "h", "left_semi").select(F.col("entry").alias("q"), "v"), "vectors")
    question = "q long, v array<double>, shelf long, lists array<long>"
    questions = space.table(vectors.mapInPandas(probed, question), "questions")
    placed = postings.withColumn("shelf", F.expr(f"list div {SHELF}")).drop("far")
    found = _read(placed, questions, k, space)
    if checked and not exactly and lists > 1:
        found = space.table(found, "found")
        radius = np.full(len(index.value.graph.points), -1.0)  # a number for each list, as many as centroids; empty lists stay out
        for row in postings.groupBy("list").agg(F.max("far").alias("far")).toLocalIterator():
            radius[row.list] = row.far
        radii = spark.sparkContext.broadcast(radius)

        def missed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            points = index.value.graph.points.astype(np.float64)
            for batch in batches:
                out = []
                for q, v, read, last in batch[["q", "v", "read", "last"]].itertuples(index=False):
                    d = np.sqrt(((points - v) ** 2).sum(1))
                    # Not farther, with room for rounding; comparisons that fail leave a list in.
                    may = (radii.value >= 0) & ~(d * (1 - 1e-9) > radii.value + last)
                    may[np.asarray(read if read is not None else [], dtype=np.int64)] = False
                    out.append((q, v, np.flatnonzero(may)))
                yield shelved(out)

        read = questions.groupBy("q").agg(F.flatten(F.collect_list("lists")).alias("read"))
        last = found.groupBy("q").agg(F.when(F.count("*") > k, F.max("score")).alias("last"))
        rest = vectors.join(read, "q", "left").join(last, "q", "left").select("q", "v", "read", F.coalesce("last", F.lit(float("inf"))).alias("last"))
        rest = space.table(rest.mapInPandas(missed, question), "rest")
        found = _best(found.unionByName(_read(placed, rest, k, space)).groupBy("q", "vec_id").agg(F.min("score").alias("score")), k + 1)
    named = asked.select(F.col("vec_id").alias("query_id"), "h").join(entries.select("h", F.col("entry").alias("q")), "h").select("query_id", "q")
    ranked = named.join(found, "q").where("vec_id != query_id")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(rows: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> pd.DataFrame:
    """Brute force on the driver, for tests and for measuring recall on tables that fit there."""
    data = valid(rows, id_col, vector_col).dropDuplicates(["vec_id"]).toPandas().sort_values("vec_id")
    ids = data["vec_id"].to_numpy()
    vectors = np.stack(data["v"].to_numpy()) if len(data) else np.zeros((0, 1))
    out = []
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        order = np.lexsort((ids, d))
        order = order[order != q][:k]
        out.append(pd.DataFrame({"query_id": ids[q], "rank": np.arange(1, len(order) + 1), "vec_id": ids[order], "score": d[order]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "rank", "vec_id", "score"])


def recall(found: pd.DataFrame, truth: pd.DataFrame) -> float:
    """Share of the true neighbours that were found."""
    both = found[["query_id", "vec_id"]].merge(truth[["query_id", "vec_id"]])
    return len(both) / max(1, len(truth))


def share_read(index: Index, vectors: np.ndarray, asked: np.ndarray) -> tuple[float, float]:
    """Rows that the lists of a query hold, as a share of all vectors, on average, and lists of a vector: for measuring."""
    lists = index.post(vectors)
    sizes = np.bincount(np.concatenate([np.array(row) for row in lists]), minlength=len(index.graph.points))
    return float(np.mean([sizes[row].sum() for row in index.probe(asked)]) / max(1, len(vectors))), float(np.mean([len(row) for row in lists]))
