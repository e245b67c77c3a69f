import pytest
from pyspark.sql import functions as F

from quillspark.functions import replies
from quillspark.operators import reports


def parse(spark, text):
    return spark.createDataFrame([(text,)], "x string").select(*(c.alias(k) for k, c in replies.parsed(F.col("x")).items())).first()


def test_parsed(spark):
    r = parse(spark, "Conforme o Art. 68,  § 1º da lei [Trecho 2], a dedução é de R$ 3.561,50 e a alíquota de 27,5%.\nVeja IRPF e o artigo 7-A.")
    assert [(c.article, c.paragraph) for c in r.citations] == [("Art. 68", "§ 1º"), ("Art. 7-A", None)]
    assert r.monetary_values == [3561.5] and r.percentages == [27.5] and r.key_terms == ["IRPF"] and "Trecho" not in r.clean_text
    assert abs(r.confidence - 0.9) < 1e-9 and r.has_answer and not r.needs_clarification and r.warnings == []
    r = parse(spark, "Não encontrei essa informação nos documentos consultados.")
    assert abs(r.confidence - 0.3) < 1e-9 and not r.has_answer and r.warnings == []
    r = parse(spark, "Poderia esclarecer qual tipo de dedução você está perguntando?")
    assert r.needs_clarification and abs(r.confidence - 0.6) < 1e-9
    assert parse(spark, None).warnings == ["Resposta muito curta"]
    assert "Menciona valores mas sem referência legal" in parse(spark, "talvez talvez possivelmente R$ 10 pela lei").warnings


def test_core(spark):
    text = "Prezado(a) usuário(a),\n\nComo assistente especializado em imposto, o prazo é maio.\n\nImportante: consulte.\nFim"
    assert spark.createDataFrame([(text,)], "x string").select(replies.core(F.col("x"))).first()[0] == "o prazo é maio."


def test_question_pairs(spark):
    text = "Sumário\n1. Qual o\nprazo?\nMaio.\nab\n12\nOutra linha.\n2. Sem pergunta\nnada\n3. Quem paga?\n4. Quanto?\nDez."
    got = [(r.n, r.question, r.answer) for r in reports.question_pairs(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("n").collect()]
    assert got == [(1, "Qual o prazo?", "Maio. Outra linha."), (2, "Quanto?", "Dez.")]


def test_reports(spark):
    runs = spark.createDataFrame([("a", 0.5, 0.5, None), ("a", 0.7, 0.5, "x"), ("b", 0.6, 0.5, None), ("c", 9.0, 9.0, None)], "config string, faithfulness double, relevance double, error string")
    r = reports.ab_test(runs, "a", "b", ["faithfulness", "relevance"]).first()
    assert r.winner == "b" and abs(r.faithfulness_diff) < 1e-9
    assert tuple(reports.success(runs).first()) == (4, 3, 1, 75.0) and reports.success(runs.limit(0)).first().rate == 0.0
    null = F.lit(None).cast("double")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(reports.overall_score(F.lit(0.5), null, null, null, F.lit(1000.0), null)) == 0.75 and one(reports.overall_score(*[null] * 6)) is None
    assert one(reports.config_label(F.lit(True), F.lit("hybrid"), F.lit(5), F.lit(0.7))) == "hybrid, k=5, α=0.7" and one(reports.config_label(F.lit(False), null.cast("string"), null, null)) == "No RAG"
    m = spark.createDataFrame([("a", {"f1": 0.1}), ("b", {"f1": 0.2}), ("c", {"x": 1.0})], "config string, metrics map<string, double>")
    assert [r.config for r in reports.metric_table(m, "f1").collect()] == ["b", "a"]


def test_patterns_are_sought_once(spark):
    """However many parts are asked for, the plan seeks articles twice: their numbers and what stands behind them."""
    text = "Conforme o Art. 68 § 1º, talvez R$ 10,50 ou 5%. " * 3
    rows = spark.createDataFrame([(text,), (None,)], "x string").select(replies.parse(F.col("x")).alias("p")).select("p.*")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Artigo") == 2
    first, second = rows.collect()
    assert len(first.citations) == 3 and first.citations[0].article == "Art. 68" and first.monetary_values == [10.5] * 3
    assert (first.confidence, second.clean_text, second.has_answer) == (pytest.approx(0.7), "", False)
