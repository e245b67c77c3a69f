import os

import pytest

import __spark_entry__ as entry
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = entry.queries()[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_streaming_ingest(spark, tmp_path):
    from quillspark.streaming.ingest import ingest, stream_documents

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "Uma frase. Outra frase.", "s")], "doc_id long, text string, source string")
    rows.write.parquet(src)
    for _ in range(2):
        ingest(stream_documents(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["e3_legal_lines", "e4_article_starts", "a9_segmented_sections"])
def test_every_line_is_processed(spark, name):
    lines = sum(r.text.count("\n") + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())
    assert entry.queries()[name](spark, SF).count() == lines


def test_whole_answers_are_parsed(spark, tmp_path):
    texts = [(40, "x " * 2000 + "Art. 9 e R$ 3"), (1, "x " * 2000 + "artigo 8")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["j8_parsed_answers"](spark, str(tmp_path)).collect()}
    assert (got[40].n_citations, got[1].n_citations) == (2, 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_hybrids_are_run(spark):
    rows = entry.queries()["l22_experiment_runs"](spark, SF).collect()
    found = {r.config for r in rows if r.n_chunks}
    assert len({r.config for r in rows}) == 13 and {f"hybrid_{a}_k{k}" for a in (0.7, 0.5) for k in (3, 5, 10)} <= found
