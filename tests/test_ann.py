"""Inverted lists: exact mode against all scores, recall, cells that are not read."""

import numpy as np
import pytest

from quillspark.operators import ann, retrieval


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8))
    x = middle[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.3
    x[:400] = x[0]  # a large group of equal vectors
    x[5] = 0
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(5000, None)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 40 == 0 and v] + [(9, [0.0] * 8)], "query_id long, vector array<double>")
    return vectors, asked, ann.CellIndex.build(vectors)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 50])
def test_exact_is_exact(sides, k):
    vectors, asked, index = sides
    assert rows_of(index.exact(asked, k, probes=1)) == rows_of(retrieval.dense_top(vectors.where("vector is not null"), asked, k))


def test_recall_grows_with_probes(sides):
    vectors, asked, index = sides
    true = retrieval.dense_top(vectors.where("vector is not null"), asked.where("query_id <> 9"), 10)
    shares = [np.mean([r.recall for r in ann.recall(index.search(asked, 10, p), true).collect()]) for p in (1, 8, len(index.centres))]
    assert shares[0] <= shares[1] <= shares[2] == 1.0 and shares[1] >= 0.9


def test_other_cells_are_not_read(sides):
    _, asked, index = sides
    plan = index.search(asked.limit(1), 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and "cell#" in plan.split("PartitionFilters")[1]
    assert index.lists.select("cell").distinct().count() > 10


def test_several_passes_and_few_vectors(spark, sides, monkeypatch):
    vectors, asked, index = sides
    want = rows_of(index.exact(asked, 5))
    monkeypatch.setattr(retrieval, "SCORES", 60)
    assert rows_of(index.exact(asked, 5)) == want
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    small = ann.CellIndex.build(few, cells=10)
    assert len(small.centres) == 2
    q = few.selectExpr("id as query_id", "vector")
    assert [r.id for r in small.search(q, 2, 1).where("query_id = 1").orderBy("rank").collect()] == [1, 2]
    assert small.exact(q.limit(0)).count() == 0


def test_probes_are_measured(sides):
    vectors, asked, index = sides
    few, many = index.calibrated(10, 0.5), index.calibrated(10, 0.97)
    assert 1 <= few <= many <= len(index.centres) and index.calibrated(10, 1.0) >= many
    true = retrieval.dense_top(vectors.where("vector is not null"), asked.where("query_id <> 9"), 10)
    assert np.mean([r.recall for r in ann.recall(index.search(asked, 10, many), true).collect()]) >= 0.9
