"""Table functions against the plain kernels, their argument checks, and a long text in a worker's memory."""

import random
import resource

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark.operators import chunking, sections, tables
from quillspark.sources import laws


@pytest.fixture(scope="module")
def sql(spark):
    return tables.register(spark).sql


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXTS = [(1, "Um. Dois. " * 300 + "Art. 7 fim. CAPÍTULO II Das coisas. x."), (2, None), (3, ""), (4, "curto"), (None, "## T\n" + "a b c. " * 400 + "\n\n" + "d. " * 30), (5, "§ 1 a. " * 60 + "fim")]


def test_lateral_chunkers(spark, sql):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = rows_of(sql("SELECT d.doc_id, c.* FROM {docs} AS d, LATERAL chunk_sentences(d.text, max_size => 300, min_size => 50) AS c", docs=docs))
    assert got == rows_of(chunking.chunked(docs, max_size=300, min_size=50)) and len(got) > 10
    got = rows_of(sql("SELECT d.doc_id, c.* FROM {docs} AS d, LATERAL chunk_markdown(d.text, overlap => 0) AS c", docs=docs))
    assert got == rows_of(chunking.chunked(docs, method="markdown", overlap=0))


def test_partitioned_functions(spark, sql):
    """Rows in any order and on any partition: documents stand together and in order."""
    rng = random.Random(2)
    heads = ["LIVRO I", "DAS COISAS", "CAPÍTULO II", "ANEXO", "REGULAMENTO", "", None, "Art. 3"]
    rows = [(d, k, rng.choice(heads), rng.choice([None, 0, 1, 2, 3, 4, 6]), rng.choice([None, "", "a. " * 20, "p\n\n" * 300])) for d in (1, 2, None, 7) for k in range(40)]
    rng.shuffle(rows)
    secs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, position int, title string, level int, content string, n string").repartition(5)
    assert rows_of(sql("SELECT * FROM chunk_sections(TABLE({secs}), id => 'doc_id', max_size => 200)", secs=secs).where("doc_id is not null")) == rows_of(sections.chunk_sections(secs, "doc_id", 200).where("doc_id is not null"))
    got = sql("SELECT * FROM merge_headings(TABLE({secs}), id => 'doc_id')", secs=secs)
    assert rows_of(got) == rows_of(laws.merged(secs, "doc_id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(partition_by" in plan and "collect_list" not in plan


def test_arguments_are_checked(spark, sql):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for bad in ("chunk_sections(TABLE({docs}), id => 'doc_id')", "chunk_sections(TABLE({docs}), id => NULL)", "chunk_sentences(7)", "chunk_sentences('a', max_size => 'b')"):
        with pytest.raises(AnalysisException):
            sql(f"SELECT * FROM {bad}", docs=docs).collect()
    with pytest.raises(AnalysisException):
        sql("SELECT c.* FROM {docs} AS d, LATERAL chunk_sentences(d.text, max_size => d.doc_id) AS c", docs=docs).collect()


def test_empty_table(spark, sql):
    none = spark.createDataFrame([], "doc_id long, position int, title string, level int, content string")
    assert sql("SELECT * FROM merge_headings(TABLE({none}), id => 'doc_id')", none=none).count() == 0
    assert sql("SELECT c.* FROM {none} AS d, LATERAL chunk_markdown(d.content) AS c", none=none).count() == 0


@pytest.mark.parametrize("kernel", [chunking.sentence_chunks, chunking.markdown_chunks])
def test_long_text_is_streamed(kernel):
    """10 MB: chunks come one at a time; the kernel holds the text, a section and a chunk."""
    text = "Uma frase de um texto longo sem fim. " * 270_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = size = 0
    for c in kernel(text):
        n, size = n + 1, max(size, len(c["content"]))
    assert n > 9_000 and size <= 1_500
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_sql_function_of_a_long_document(spark, sql):
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("Uma frase de um texto longo sem fim. "), F.lit(270_000)).alias("text"))
    assert sql("SELECT c.* FROM {docs} AS d, LATERAL chunk_sentences(d.text) AS c", docs=docs).count() > 9_000


def test_small_chunks_are_merged_as_they_come():
    def whole(chunks, most=1000, least=100):  # with all chunks in hand
        out, i = [], 0
        while i < len(chunks):
            text, flag = chunks[i]
            after = chunks[i + 1] if i + 1 < len(chunks) else None
            if len(text) < least and after and len(text) + len(after[0]) <= 1.5 * most:
                out.append([f"{text} {after[0]}", flag or after[1]])
                i += 2
                continue
            if len(text) < least and not after and out and len(out[-1][0]) + len(text) <= 1.5 * most:
                out[-1] = [f"{out[-1][0]} {text}", out[-1][1] or flag]
            else:
                out.append([text, flag])
            i += 1
        return out

    rng = random.Random(4)
    for _ in range(500):
        chunks = [["x" * rng.choice([5, 50, 99, 100, 700, 1450, 1600]), rng.random() < 0.5] for _ in range(rng.randrange(7))]
        assert chunking.merge_small([list(c) for c in chunks]) == whole(chunks)
