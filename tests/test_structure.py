from pyspark.sql import functions as F

from quillspark.operators import structure

LAW = """# Lei
### LIVRO I DAS COISAS
##### CAPÍTULO I DO INÍCIO
## Art. 1º
Texto um, conforme a Lei nº 9.250/95.
  - I - primeiro
### LIVRO II DO RESTO
## Art. 2
Texto dois.
## Art. 2
repetido
## ANEXO UNICO
## Art. 1º
Texto do anexo.
##### Este texto não substitui o publicado"""


def test_articles(spark):
    rows = {r.chunk_id: r for r in structure.articles(spark.createDataFrame([(7, LAW)], "doc_id int, text string")).collect()}
    assert set(rows) == {"7_preambulo_art_1", "7_preambulo_art_2", "7_anexo_art_1"}
    assert rows["7_preambulo_art_1"].hierarchy == "LIVRO I DAS COISAS > CAPÍTULO I DO INÍCIO"
    assert rows["7_preambulo_art_2"].livro == "LIVRO II DO RESTO" and rows["7_preambulo_art_2"].capitulo == "CAPÍTULO I DO INÍCIO"
    assert rows["7_preambulo_art_2"].content.endswith("Texto dois.") and rows["7_anexo_art_1"].content.endswith("Texto do anexo.")


def test_sections_and_metadata(spark):
    text = "intro " * 30 + "\n## A\n" + "x" * 120 + "\n### B\nshort"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [(r.section, r.title) for r in structure.markdown_sections(df).orderBy("section").collect()] == [(0, "Introdução"), (1, "A")]
    m = spark.createDataFrame([(LAW,)], "x string").select(*(c.alias(k) for k, c in structure.chunk_metadata(F.col("x")).items())).first()
    assert m.num_incisos == 1 and not m.has_alineas and m.references == ["Lei nº 9.250/95"]


def test_context(spark):
    df = spark.createDataFrame([(1, 1, "a" * 10), (1, 2, "b" * 100), (1, 3, "c")], "query_id int, rank int, content string")
    assert structure.context(df, 60).first().context == "[Trecho 1]\n" + "a" * 10 + "\n"
