import pytest

from quillspark.sources import laws

STYLED = """<html><body><p>Preâmbulo da lei nº 1, texto.</p><p class="Capitulo">CAPÍTULO I</p><p class="Capitulo">DO INÍCIO</p>
<p class="MsoNormal">Art. 1º O imposto é devido.</p><p class="texto1">§ 1º Sem exceção.</p><p class="MsoNormal">I - primeiro</p>
<table><tr><td>a</td><td><p>b|c</p></td></tr><tr><td>1</td></tr></table><p class="citacaopn">citado aqui</p><p class="04ParteNormativa">texto da parte, art. 9</p>
<p>LIVRO II</p><h3>Outro <b>título</p><script>var x = "<p>no</p>";</script><p>Art. 5, inciso II, alterado.</p></body></html>"""

SEGMENTED = """<app-root><div class="segmento"><span class="x">Num. 7</span> <span class="conteudo-segmento-ato">O texto inicial.</span></div>
<div class="epigrafe-ato">INSTRUÇÃO Nº 1</div><div class="caixinha-ementa">Dispõe sobre<br>algo.</div>
<div class="segmento"><span class="conteudo-segmento-ato">Art. 1º Esta norma vale.</span></div><div class="segmento">a) uma letra</div><div class="segmento">ab</div></app-root>"""


def rows(df):
    return [(r.title, r.level, r.content) for r in df.orderBy("position").collect()]


def test_styled(spark):
    df = spark.createDataFrame([(1, STYLED), (2, None), (3, "")], "page_id int, html string")
    out = laws.styled_sections(df)
    assert {r.page_id for r in out.collect()} == {1}
    assert rows(out) == [
        ("", 0, "Preâmbulo da lei nº 1, texto."),
        ("CAPÍTULO I", 3, ""),
        ("DO INÍCIO", 3, ""),
        ("Art. 1º", 3, "O imposto é devido.\n\n**§ 1º Sem exceção.**\n\n- I - primeiro\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |\n> citado aqui\ntexto da parte, art. 9"),
        ("LIVRO II", 1, ""),
        ("Outro título", 3, "Art. 5, inciso II, alterado."),
    ]
    assert rows(laws.merged(out))[1][:2] == ("CAPÍTULO I - DO INÍCIO", 3)


def test_segmented(spark):
    df = spark.createDataFrame([(1, SEGMENTED), (2, "<p>Plain</p>")], "page_id int, html string")
    assert rows(laws.segmented_sections(df)) == [
        ("INSTRUÇÃO Nº 1", 1, ""),
        ("Ementa", 2, "Dispõe sobre algo."),
        ("", 0, "O texto inicial."),
        ("Art. 1º Esta norma vale.", 6, "- a) uma letra"),
    ]


@pytest.mark.parametrize(
    "sections, titles",
    [
        ([("ANEXO", 2, ""), ("REGULAMENTO DO IMPOSTO", 2, "x")], ["ANEXO - REGULAMENTO DO IMPOSTO"]),
        ([("LIVRO I", 1, ""), ("DAS PESSOAS", 5, ""), ("DO MAIS", 5, ""), ("Outro", 5, "")], ["LIVRO I - DAS PESSOAS\nDO MAIS", "Outro"]),
        ([("TÍTULO I", 2, ""), ("Sem preposição", 5, "")], ["TÍTULO I", "Sem preposição"]),
        ([("Seção II", 4, ""), ("Prazos", 5, ""), ("Art. 2º", 3, "x")], ["Seção II - Prazos", "Art. 2º"]),
        ([("CAPÍTULO I", 3, ""), ("Art. 1º", 3, "")], ["CAPÍTULO I", "Art. 1º"]),
        ([("CAPÍTULO I", 3, "texto"), ("DO FIM", 3, "")], ["CAPÍTULO I", "DO FIM"]),
        ([], []),
    ],
)
def test_merge(sections, titles):
    assert [t for t, _, _ in laws.merge_headings(sections)] == titles


def test_elements_of_many_pages(spark, monkeypatch):
    """A few pages' elements are held at a time; a page larger than that goes alone."""
    monkeypatch.setattr(laws, "SLICE", 40)
    pages = spark.createDataFrame([(f"p{i}", None if i == 5 else "<p>abc</p>" * (i % 4)) for i in range(12)], "page_id string, html string").coalesce(1)
    got = sorted((r.page_id, r.pos, r.kind, r.tag, list(r.classes), r.text) for r in laws.elements(pages).collect())
    assert got == sorted((f"p{i}", j, "block", "p", [], "abc") for i in range(12) if i != 5 for j in range(i % 4))
