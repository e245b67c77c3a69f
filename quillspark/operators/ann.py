"""Approximate nearest neighbours by cosine: inverted lists of k-means cells, with bounds that make the search exact where wanted.

build fits the cells on a bounded sample (SAMPLE vectors, a parameter), puts every vector of length one into the list of its
nearest cell, and writes the lists as folders by cell, so that a search reads the folders of the cells that it probes and no
others. Each cell keeps its radius, the greatest distance of a vector from its centre.

search probes the nearest cells of each question. exact probes them too and then every other cell that could hold something
better: a vector of a cell is no nearer to a question than the centre's distance less the radius, and where that is
farther than the k-th best found the cell is left out. Its rows are those of retrieval.dense_top.

Scores are made in numpy, a bounded number at a time; a task holds the best rows of its questions. Questions beyond what
may be broadcast go in several passes. Vectors are not shuffled. A cell may be of any size: its files are read by many tasks.

Defined cases: a zero vector has similarity 0 with all. Null vectors are left out. Fewer vectors than cells give fewer cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved, shared_dir
from . import retrieval

#: Vectors that the cells are fitted on, rounds of k-means, vectors that a task assigns at a time.
SAMPLE, ROUNDS, BATCH = 50_000, 12, 4096


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-300)))


def centres_of(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """k-means of the rows of x: seeded rows to begin with, empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)[0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), BATCH):
        d = _distances(x[a : a + BATCH], c)
        near[a : a + BATCH] = d.argmin(1)
        far[a : a + BATCH] = d.min(1)
    return near, far


@dataclass
class CellIndex:
    """lists(cell, id, vector) by folders of cells; centres and radii by cell (a few thousand rows of a vector's width)."""

    lists: DataFrame
    centres: np.ndarray
    radii: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, path: str | None = None) -> CellIndex:
        """vectors: id, vector. cells: about the square root of their number, 4096 at most, unless given."""
        spark = vectors.sparkSession
        rows = saved(vectors.where("vector is not null").select("id", unit(F.col("vector")).alias("vector")))
        n = rows.count()
        cells = cells or min(4096, max(1, round(n**0.5)))
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(min(1 << 20, (2 * sample << 20) // max(n, 1)))
        some = rows.where(share).limit(sample).select("vector").toPandas()["vector"]
        centres = centres_of(np.stack(some), cells) if len(some) else np.zeros((1, 1))
        shared = spark.sparkContext.broadcast(centres)

        def assign(frames):
            for f in frames:
                if len(f):
                    near, far = _nearest(np.stack(f["vector"]), shared.value)
                    yield pd.DataFrame({"id": f["id"], "vector": f["vector"], "away": far, "cell": near})

        path = path or f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/cells-{id(rows)}-{n}"
        kind = dict(rows.dtypes)["id"]
        dealt = rows.mapInPandas(assign, f"id {kind}, vector array<double>, away double, cell long")
        dealt.write.mode("overwrite").partitionBy("cell").parquet(path)
        lists = spark.read.schema(f"id {kind}, vector array<double>, away double, cell long").parquet(path)
        radii = np.zeros(len(centres))
        for r in lists.groupBy("cell").agg(F.max("away").alias("r")).collect():  # a row for each cell
            radii[r.cell] = r.r
        return CellIndex(lists.select("cell", "id", "vector"), centres, radii)

    def _probe(self, q: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int, kind: str) -> DataFrame:
        """Best rows of the questions among the cells that they want (a truth value for each question and cell)."""
        spark = self.lists.sparkSession
        cells = np.flatnonzero(wanted.any(0)).tolist()
        shared = spark.sparkContext.broadcast((q, ids, {c: np.flatnonzero(wanted[:, c]) for c in cells}))

        def run(frames):
            q, ids, asked = shared.value
            held = None
            for f in frames:
                for cell, rows in f.groupby("cell", sort=False):
                    x, doc, own = np.stack(rows["vector"]), rows["id"].to_numpy(), asked[cell]
                    wide = max(1, retrieval.SCORES // len(x))
                    for a in range(0, len(own), wide):
                        s = np.round(q[own[a : a + wide]] @ x.T, 9)
                        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(s), -np.inf)
                        row, col = np.nonzero(s >= least[:, None])
                        new = (own[a + row], s[row, col], doc[col])
                        held = retrieval._best(*(np.concatenate(y) for y in zip(held, new, strict=True)), k) if held else retrieval._best(*new, k)
            if held:
                yield pd.DataFrame({"query_id": ids[held[0]], "id": held[2], "score": held[1]})

        rows = self.lists.where(F.col("cell").isin(cells)) if len(cells) < len(self.centres) else self.lists
        return rows.mapInPandas(run, f"query_id {kind}, id {dict(self.lists.dtypes)['id']}, score double")

    def _passes(self, queries: DataFrame, k: int):
        """Questions (matrix, ids) in parts that may be broadcast, and whose best rows a task may hold."""
        n, width = queries.count(), self.centres.shape[1]
        parts = max(1, -(-n * (width + len(self.centres)) * 8 // retrieval.BROADCAST_BYTES), -(-n * k // retrieval.SCORES))
        rows = queries.where("vector is not null").select("query_id", unit(F.col("vector")).alias("vector"))
        for i in range(parts):
            pdf = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).toPandas()
            if len(pdf):
                yield np.stack(pdf["vector"]), pdf["query_id"].to_numpy()

    def _near(self, q: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        away = _distances(q, self.centres)
        wanted = np.zeros(away.shape, bool)
        np.put_along_axis(wanted, np.argsort(away, axis=1, kind="stable")[:, :probes], True, 1)
        return away, wanted

    def search(self, queries: DataFrame, k: int = retrieval.TOP_K, probes: int = 8) -> DataFrame:
        """query_id, id, score, rank of queries (query_id, vector): the best among the nearest cells."""
        return self._ranked(queries, k, probes, False)

    def calibrated(self, k: int = 10, target: float = 0.95, sample: int = 256) -> int:
        """The least number of cells to probe for a mean recall of target, measured on a bounded sample of the indexed vectors."""
        some = self.lists.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), "vector")
        some = saved(some)
        true = self.exact(some, k).join(self.lists.select("id", "cell"), "id").select("query_id", "cell").toPandas()  # k rows for each
        asked = some.toPandas()
        if not len(true):
            return 1
        order = np.argsort(np.argsort(_distances(np.stack(asked["vector"]), self.centres), axis=1, kind="stable"), axis=1)
        place = {x: i for i, x in enumerate(asked["query_id"].tolist())}
        rank = np.sort(order[[place[x] for x in true["query_id"]], true["cell"].to_numpy()])
        return int(rank[max(0, int(np.ceil(target * len(rank))) - 1)]) + 1

    def exact(self, queries: DataFrame, k: int = retrieval.TOP_K, probes: int = 8) -> DataFrame:
        """The best of all: cells are left out by their bounds only."""
        return self._ranked(queries, k, probes, True)

    def _ranked(self, queries: DataFrame, k: int, probes: int, exact: bool) -> DataFrame:
        kind = dict(queries.dtypes)["query_id"]
        out = None
        for q, ids in self._passes(queries, k):
            away, wanted = self._near(q, probes)
            found = self._probe(q, ids, wanted, k, kind)
            if exact:
                found = saved(found)
                worst = np.full(len(q), -np.inf)
                place = {x: i for i, x in enumerate(ids.tolist())}
                for r in retrieval.top(found, k).where(F.col("rank") == k).collect():  # a row for each question of the pass
                    worst[place[r.query_id]] = r.score
                best = 1 - np.maximum(away - self.radii[None, :] - 1e-9, 0) ** 2 / 2
                more = ~wanted & (best >= worst[:, None] - 2e-9)
                if more.any():
                    found = found.unionByName(self._probe(q, ids, more, k, kind))
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.lists.sparkSession.createDataFrame([], f"query_id {kind}, id {dict(self.lists.dtypes)['id']}, score double")
        return retrieval.top(out, k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """query_id, recall: the share of the true rows that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return true.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
