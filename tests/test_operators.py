import math

import pytest

from quillspark.operators import analytics, chunking, retrieval
from quillspark.sources import files, pages


def test_rrf(spark):
    rank = "query_id int, id string, score double, rank int"
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "c", 0.7, 3)], rank)
    sparse = spark.createDataFrame([(1, "b", 5.0, 1), (1, "d", 4.0, 2)], rank)
    got = [(r.id, round(r.score, 6)) for r in retrieval.hybrid(dense, sparse, 5).orderBy("rank").collect()]
    assert got == [("b", 0.016208), ("a", 0.011475), ("c", 0.011111), ("d", 0.004839)]


def test_bm25_negative_idf(spark):
    docs = spark.createDataFrame([(1, "abcd efgh"), (2, "abcd xyzw"), (3, "pqrs")], "id int, text string")
    idf = {r.term: r.idf for r in retrieval.BM25Index.build(docs, "id", "text").terms.collect()}
    rare, common = math.log(2.5) - math.log(1.5), math.log(1.5) - math.log(2.5)
    assert idf["efgh"] == pytest.approx(rare)
    assert idf["abcd"] == pytest.approx(0.25 * (3 * rare + common) / 4)


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query_id int, vector array<double>")
    assert [r.id for r in retrieval.dense_top(v, q, 2).orderBy("rank").collect()] == [1, 3]


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, document string, m string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, document string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert [r[:2] for r in rows(files.add(t, new))] == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(files.update(t, new))[1][:2] == (2, "B")
    assert [r[0] for r in rows(files.delete(t, new))] == [1]


def test_sentence_chunks():
    text = "CAPÍTULO I das coisas. " + "Uma frase qualquer aqui. " * 60
    chunks = chunking.pack_sentences(text)
    assert all(len(c["content"]) <= 1500 for c in chunks) and len(chunks) > 1
    assert "".join(c["content"].replace(" ", "") for c in chunks).count("Umafrasequalqueraqui.") == 60


def test_merge_small():
    assert [c[0] for c in chunking.merge_small([["a" * 50, False], ["b" * 500, True], ["c" * 10, False]])] == ["a" * 50 + " " + "b" * 500 + " " + "c" * 10]


def test_markdown():
    assert [s[0] for s in chunking.markdown_sections("intro " * 30 + "\n## A\n" + "x" * 120 + "\n### B\nshort")] == ["Introdução", "A"]
    assert chunking.markdown_sections("tiny")[0][0] == "Documento Completo"


def test_stack():
    assert chunking.context_stack([1, 3, 4, 2], ["L", "C", "A", "T"]) == ["", "L", "L", "L"]


def test_page():
    page = pages.read_page("<title>T</title><body><h1>A</h1><p>um<br>dois</p><script>x</script><h2>B</h2><p>tres</p></body>")
    assert page["title"] == "T" and [(s["title"], s["content"], s["level"]) for s in page["sections"]] == [("A", "um dois", 1), ("B", "tres", 2)]
    assert pages.table_to_markdown([["a|b", "c"], ["d"]]) == "| a\\|b | c |\n| --- | --- |\n| d |  |"


def test_first_title():
    page = pages.read_page("<head><title> Page 1</title></head><body><html><head><title>47 others</title></head><p>text</p></body>")
    assert page["title"] == "Page 1" and page["sections"][0]["content"] == "text"


def test_effect(spark):
    runs = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0)] + [("b", x) for x in (2.0, 3.0, 4.0)], "config string, value double")
    r = analytics.cohens_d(runs, "a", "b").first()
    assert r.d == pytest.approx(-1.0) and r.effect == "large"
    assert analytics.t_p_value(2.0, 10) == pytest.approx(0.07339, abs=1e-4)


def test_bm25_blocks_and_passes(spark, monkeypatch):
    """All scores by hand, with blocks of few documents and several passes; a question's hits aren't shuffled, only the best rows of each task."""
    texts = [" ".join(f"word{(i * i + 7 * j) % (j + 3)}" for j in range(i % 40)) for i in range(300)]
    asked = {q: f"word{q} word{q + 1} word{q} nowhere" for q in range(20)}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    questions = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    words = [t.split() for t in texts]
    df = {t: sum(t in w for w in words) for w in words for t in w}
    raw = {t: math.log(300 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}
    mean = sum(map(len, words)) / 300
    want = set()
    for q, text in asked.items():
        terms = [t for t in text.split() if t in idf]
        score = {i: round(sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in terms), 9) for i, w in enumerate(words)}
        want |= {(q, i, round(score[i], 6), n + 1) for n, i in enumerate(sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:7])}
    index = retrieval.BM25Index.build(docs, "id", "text")
    for scores, rows in ((4_000_000, 500_000), (140, 500_000), (100, 20)):
        monkeypatch.setattr(retrieval, "SCORES", scores)
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", rows)
        found = index.search(questions, 7)
        assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not any("hashpartitioning(query_id" in x and "id#" in x.split("hashpartitioning(query_id", 1)[1].split(",", 1)[1] for x in plan.splitlines() if "Exchange" in x)
    assert index.search(questions.where("query_id < 0")).count() == 0
