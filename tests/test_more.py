import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import legal, prompts, questions
from quillspark.operators import experiments, sections
from quillspark.sources import pages, providers


def one(spark, value, *columns, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(*columns).first()


@pytest.mark.parametrize(
    "line, level, markdown",
    [
        ("  livro I Das coisas", 1, "\n# livro I Das coisas\n"),
        ("SEÇÃO 2-A Dos prazos", 4, "\n#### SEÇÃO 2-A Dos prazos\n"),
        ("Art. 6º-A. Texto", 6, "\n###### Art. 6º-A. Texto {#art-6-a}\n"),
        ("art. 7 minúsculo", None, "art. 7 minúsculo"),
        ("§ único. Texto", None, "\n**§ único. Texto**\n"),
        ("IV – quarto", None, "- IV – quarto"),
        ("a) letra", None, "  - a) letra"),
        ("3. terceiro", None, "  - 3. terceiro"),
        ("", None, ""),
    ],
)
def test_legal_lines(spark, line, level, markdown):
    assert tuple(one(spark, line, legal.heading_level(F.col("x")), legal.to_markdown_line(F.col("x")))) == (level, markdown)


@pytest.mark.parametrize(
    "text, start",
    [("Art. 1.000. O imposto", True), ("Art. 3-A", True), ("Art. 5, inciso II", False), ("art. 2º e art. 4º ao art. 71", False), ("Art. 7º o contribuinte", True), ("Conforme o Art. 2", False), (None, False)],
)
def test_article_start(spark, text, start):
    assert one(spark, text, legal.is_article_start(F.col("x")))[0] is start


def test_article_head(spark):
    assert tuple(one(spark, "Art. 68-B. Fica\nisento", *legal.article_head(F.col("x")))) == ("Art. 68-B.", "Fica\nisento")
    assert tuple(one(spark, "Outro", *legal.article_head(F.col("x")))) == ("Outro", "")


def test_question_labels(spark):
    df = spark.createDataFrame([("Qual o prazo de entrega? A multa?", "Exceto o art. 3º da Lei nº 9.250, de 1995, e o art. 4-A; ver Lei nº 7.713 art. 6. Até 2 de maio de 2024, R$ 10,50 à RFB.")], "q string, a string")
    r = df.select(*(c.alias(k) for k, c in questions.labels(F.col("q"), F.col("a")).items())).first()
    assert (r.category, r.kind, r.complexity, r.difficulty) == ("prazo", "procedimental", "simple", "facil")
    assert r.has_conditions and r.has_references and not r.has_examples
    assert [(x.law, x.articles) for x in r.answer_laws] == [("Lei nº 9.250, de 1995", ["4-A"]), ("Lei nº 7.713", ["6"])] and r.question_laws == []
    assert r.organizations == ["RFB"] and r.monetary_values == ["R$ 10,50"] and r.dates == ["1995", "2 de maio de 2024"]
    assert (r.article, r.paragraph, r.clause) == ("3", None, None)
    assert [tuple(x) for x in one(spark, "ver art. 5 e artigo 2", questions.laws(F.col("x")))[0]] == [("Legislação Citada", ["2", "5"])]
    assert one(spark, "nada", questions.laws(F.col("x")))[0] == []


def test_prompts(spark):
    q, c = F.lit("Quanto é o imposto devido? {context}"), F.array(F.lit("um"), F.lit("dois"))
    got = one(spark, "", prompts.with_context(q, c))[0]
    assert got.startswith(prompts.system("calculation")) and "[Trecho 1]\num\n\n[Trecho 2]\ndois" in got and "devido? {context}" in got
    assert one(spark, "unknown", prompts.render(F.col("x"), F.lit("q"), F.lit("c")))[0].startswith(prompts.system("rag_default"))
    example = F.array(F.struct(F.lit("p").alias("question"), F.lit("r").alias("answer")))
    assert "Exemplo 1:\nPergunta: p\nResposta: r" in one(spark, "", prompts.few_shot(F.lit("q"), c, example))[0]
    cited = F.array(F.struct(F.lit("Art. 1").alias("article"), F.lit(None).cast("string").alias("paragraph")))
    assert one(spark, "", prompts.display(F.lit("t"), cited, F.array().cast("array<string>")))[0] == "t\n\n📚 **Referências:**\n- Art. 1\n"


def test_providers(spark):
    class Failing(providers.HashEmbedder):
        def embed(self, texts, task="retrieval_document"):
            if "bad" in texts:
                raise RuntimeError("refused")
            return super().embed(texts, task)

    class Refusing(providers.ExtractiveAnswerer):
        def generate(self, prompt, system=None):
            if prompt == "bad":
                raise RuntimeError("refused")
            return super().generate(prompt, system)

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, text string")
    rows = {r.id: np.array(r.vector) for r in providers.embed(df, lambda: Failing(8)).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-9 and not rows[2].any() and not rows[3].any()
    said = {r.prompt: r for r in providers.answer(spark.createDataFrame([("bad",), ("[Trecho 1]\nUm dia. O prazo é maio.\n\nPergunta: Qual o prazo?",)], "prompt string"), Refusing).collect()}
    assert said["bad"].answer is None and said["bad"].error == "RuntimeError: refused"
    assert [r.answer for p, r in said.items() if p != "bad"] == ["O prazo é maio. [Trecho 1]"]
    with pytest.raises(ValueError):
        providers.create(providers.ANSWERERS, "absent")


def test_section_chunks():
    titles, levels, contents = ["A", "B", "C", "D"], [1, 3, 4, 2], ["a", "b", "c", "p1\n\n" + "q" * 30 + "\n\np3"]
    got = sections.chunk(titles, levels, contents, 20)
    assert [c["content"] for c in got[:3]] == ["a", "A\n\nb", "A > B\n\nc"]
    assert [(c["content"], c["part_number"]) for c in got[3:]] == [("A\n\np1", 1), ("A\n\n" + "q" * 30, 2), ("A\n\n\n\np3", 3)]
    assert sections.chunk(titles, levels, contents, 20, legacy=True)[2]["content"] == "A\n\nc"
    assert sections.chunk([], [], []) == [] and sections.chunk(["x"], [1], [None])[0]["content"] == ""


def test_outline_and_markdown(spark):
    rows = [(1, i, f"T{i} {{#t}}", 1 + (i > 1) + (i > 3), "c" if i == 1 else "") for i in range(6)] + [(2, 0, "", 0, "alone")]
    df = spark.createDataFrame(rows, "doc_id int, position int, title string, level int, content string")
    assert [r.entry for r in sections.outline(df, most=4).orderBy("position").collect()] == ["# T0", "# T1", "## T2", "## T3"]
    assert {r.doc_id: r.depth for r in sections.depth(df, most=1).collect()} == {1: 1}
    text = {r.doc_id: r.markdown for r in sections.markdown(df).collect()}
    assert text[2] == "alone" and text[1].startswith("# T0 {#t}\n\n# T1 {#t}\n\nc\n\n## T2")
    assert one(spark, 5, sections.bar(F.col("x"), F.lit(10), 15), schema="x int")[0] == "█" * 8 + "░" * 7
    assert one(spark, 5, sections.bar(F.col("x"), F.lit(0), 3), schema="x int")[0] == "░░░"


def test_scores(spark):
    a, b = np.random.default_rng(1).normal(size=(3, 4)), np.random.default_rng(2).normal(size=(2, 4))
    r = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<array<double>>").select(*(c.alias(k) for k, c in experiments.greedy_match(F.col("a"), F.col("b")).items())).first()
    s = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert r.precision == pytest.approx(s.max(axis=1).mean()) and r.recall == pytest.approx(s.max(axis=0).mean())
    assert one(spark, [1, 0, 1], experiments.context_precision(F.col("x")), schema="x array<int>")[0] == pytest.approx((1 + 2 / 3) / 2)
    assert one(spark, [0, 0], experiments.context_precision(F.col("x")), schema="x array<int>")[0] == 0.0
    assert len(experiments.judged_metrics(True)) == 7


def test_experiments(spark):
    assert experiments.grid(spark).count() == 13
    ranks = spark.createDataFrame([("dense", None, 1, 10 + i, i) for i in range(1, 6)], "method string, alpha double, query_id int, id int, rank int")
    got = {(r.config, r.query_id): r for r in experiments.run(experiments.grid(spark), spark.createDataFrame([(1,), (2,)], "query_id int"), ranks).collect()}
    assert len(got) == 26 and got["dense_k3", 1].ids == [11, 12, 13] and got["dense_k10", 1].n_chunks == 5
    assert got["baseline", 1].n_chunks == 0 and got["dense_k3", 2].n_chunks == 0
    q = spark.createDataFrame([(i,) for i in range(40)], "id int")
    example, rest = experiments.few_shot_example(q, "id")
    assert [r.id for r in example.collect()] == [29] and rest.count() == 29
    assert one(spark, "abc", experiments.preview(F.col("x"), 2))[0] == "ab..."


def nested(spark, *rows):
    schema = "doc_id long, position int, title string, level int, content string"
    return {r[0]: r[1] for r in sections.nested_markdown(spark.createDataFrame(list(rows), schema)).collect()}


def test_nested_markdown_levels_follow_the_structure(spark):
    out = nested(
        spark,
        (1, 0, None, 0, "DECRETO Nº 1\nEmenta"),
        (1, 1, "Art. 1º Fica aprovado", 3, "§ 1º Vale já"),
        (1, 2, "ANEXO", 1, ""),
        (1, 3, "LIVRO I", 1, None),
        (1, 4, "CAPÍTULO II", 3, "texto"),
        (1, 5, "Subseção I", 5, ""),
        (1, 6, "Art. 2º", 6, "§ 1º Dos casos\nI - um\na) letra\n\n  solto"),
    )[1]
    lines = [x for x in out.split("\n") if x.strip()]
    assert lines == [
        "# DECRETO Nº 1", "## 📖 Texto Normativo", "DECRETO Nº 1", "Ementa", "  * Art. 1º Fica aprovado", "    - **§ 1º** Vale já", "## ANEXO", "### LIVRO I", "##### CAPÍTULO II", "texto",
        "  * **Subseção I**", "  * Art. 2º", "    - **§ 1º** Dos casos", "      - I - um", "      - a) letra", "  solto",
    ]


def test_nested_markdown_without_structure(spark):
    out = nested(spark, (1, 0, "Nota", 0, "parágrafo único.\nII – dois\nb) três"), (2, 0, "Parte", 2, "§ 2º x\nI - um"), (3, 0, None, None, None), (4, 0, "Fim", 9, ""), (4, 1, "Fim", 10, ""))
    short = {k: [x for x in v.split("\n") if x.strip()][2:] for k, v in out.items()}
    assert short == {1: ["**Nota**", "* **parágrafo único.**", "  - II - dois", "    - b) três"], 2: ["## Parte", "### § 2º x", "#### I - um"], 3: [], 4: ["    - **Fim**", "    - **Fim**"]}
    assert out[3].startswith("# 3\n")


def test_nested_markdown_of_no_sections(spark):
    assert spark.createDataFrame([], "doc_id long, position int, title string, level int, content string").transform(sections.nested_markdown).count() == 0


def test_pages_are_read_once(spark):
    html = spark.createDataFrame([(1, "<h1>Um</h1><p>Texto longo o bastante para ficar na seção</p>"), (2, None)], "page_id long, html string")
    out = pages.pages_to_sections(html)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.page_id, r.position, r.title) for r in out.collect()] == [(1, 0, "Um")]


def test_hash_embedder_holds_few_words():
    model = providers.HashEmbedder()
    model.embed([" ".join(f"w{i}" for i in range(a, a + 30_000)) for a in range(0, 120_000, 30_000)])
    assert len(model.places) <= model.PLACES == 50_000
