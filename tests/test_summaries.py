"""Totals on several levels, sketches that are merged, and SQL functions against the Column functions and plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import answers, sqlnames, text
from quillspark.operators import chunking, retrieval, summaries
from quillspark.operators.experiments import grid, planned


@pytest.mark.parametrize("every", [False, True])
def test_totals(spark, every):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([1, 2, None]), rng.randrange(5)) for _ in range(200)]
    got = summaries.totals(spark.createDataFrame(rows, "a string, b string, c int, v int"), ["a", "b", "c"], ["v"], ["v"], every).collect()
    levels = [0, 1, 3, 7] if not every else range(8)
    want = set()
    for level in levels:
        keep = [not level >> (2 - i) & 1 for i in range(3)]
        key = lambda r: tuple(x if k else None for x, k in zip(r, keep, strict=False))  # noqa: B023, E731
        for k, some in itertools.groupby(sorted(rows, key=lambda r: str(key(r))), key):
            v = [r[3] for r in some]
            want.add((*k, level, len(v), sum(v), len(set(v))))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_sketches_are_merged(spark):
    """Sketches by day and source, merged for any subset, against the exact values; small ones are exact."""
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") % 5).alias("source"), (F.col("id") % 9000).alias("w"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("x"))
    kept = summaries.sketched(rows, ["day", "source"], {"words": F.col("w")}, {"size": F.col("x")})
    for where in ("true", "day < 2", "source = 3 and day = 1"):
        exact = rows.where(where).agg(F.count(F.lit(1)), F.countDistinct("w")).first()
        xs = sorted(r.x for r in rows.where(where).collect())
        got = summaries.merged(kept.where(where), [], ["words"], ["size"]).select("n", summaries.distinct_of("words").alias("d"), *(summaries.quantile_of("size", q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99)))).first()
        assert got.n == exact[0] and abs(got.d - exact[1]) <= 0.05 * exact[1]
        for i, q in enumerate((0.1, 0.5, 0.99)):
            assert abs(sum(x <= got[f"q{i}"] for x in xs) / len(xs) - q) < 0.03
    few = summaries.sketched(spark.range(50), [], {"words": F.col("id")}, {"size": F.col("id")}).select(summaries.distinct_of("words"), summaries.quantile_of("size", 0.5)).first()
    assert tuple(few) in {(50, 24), (50, 25)}


def test_sql_functions_are_the_columns(spark):
    x = "Qual é o prazo? Veja https://a.b/c e www.d.e/f: aaaaaaaaaaaa; Dedução, renda.  Fim "
    docs = spark.createDataFrame([(x,), ("",), (None,), ("ab cd",)], "x string").withColumn("q", F.lit("Qual o prazo da dedução?"))
    sql = sqlnames.register(spark).sql
    got = sql("SELECT quill_words(x) w, quill_tokens(x) t, quill_keywords(x) k, quill_without_urls(x) u, quill_chunk_id(x, 3) c, quill_strip(x) s, quill_estimated_tokens(x) e, quill_keyword_share(x, q) h, quill_is_repetitive(x) r FROM {docs}", docs=docs)
    c = F.col("x")
    want = docs.select(text.word_count(c), text.tokens(c), answers.keywords(c), text.remove_urls(c), chunking.chunk_id(c, F.lit(3)), text.strip(c), text.estimated_tokens(c), answers.answer_relevance(c, F.col("q")), c.rlike(r"(?s)(.)\1{9,}"))
    assert [tuple(r) for r in got.where("x is not null" if "x" in got.columns else "true").collect()][0] == tuple(want.first())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    one = sql("SELECT quill_rrf(1, 2, 0.7D) a, quill_rrf(NULL, 2, 0.7D) b, quill_cosine(array(1D, 0D), array(1D, 1D)) c, quill_cosine(array(0D), array(0D)) d").first()
    assert (one.a, one.b, one.d) == (round(0.7 / 61 + 0.3 / 62, 12), round(0.3 / 62, 12), 0.0) and abs(one.c - 0.5**0.5) < 1e-12
    assert len(sqlnames.FUNCTIONS) >= 10


def test_dense_search_in_small_steps(spark, monkeypatch):
    """Slices of any size, ties at the k-th place, several passes: the same rows as sorting all scores."""
    rng = random.Random(7)
    vectors = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(150)]
    asked = [(100 + i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(40)]
    v, q = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>")

    def plain(metric, k):
        out = []
        for n, a in asked:
            dot = lambda x, y: sum(s * t for s, t in zip(x, y, strict=True))
            score = {"ip": lambda b: dot(a, b), "l2": lambda b: 1 - dot([s - t for s, t in zip(a, b, strict=True)], [s - t for s, t in zip(a, b, strict=True)]), "cosine": lambda b: dot(a, b) / max((dot(a, a) * dot(b, b)) ** 0.5, 1e-300)}[metric]  # noqa: B023
            out += [(n, i, rank) for rank, (_, i) in enumerate(sorted((-round(score(b), 9), i) for i, b in vectors)[:k], 1)]
        return sorted(out)

    for scores in (4_000_000, 200, 20):
        monkeypatch.setattr(retrieval, "SCORES", scores)
        for metric, k in (("cosine", 5), ("l2", 1), ("ip", 200)):
            if k * len(asked) // scores < 20:
                assert sorted((r.query_id, r.id, r["rank"]) for r in retrieval.dense_top(v, q, k, metric).collect()) == plain(metric, k)


def test_planned_runs(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert planned(grid(spark), asked).count() == 26
