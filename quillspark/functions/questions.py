"""Labels of question and answer pairs: category, kind, difficulty, entities, laws with their articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, word_count

# Words of each category and kind, in order of priority; technical terms; signs of what an answer holds.
CATEGORIES = {
    "obrigatoriedade": ("obrigado", "obrigada", "obrigatório", "obrigação", "deve declarar"),
    "deducoes": ("dedução", "deduzir", "abater", "despesa", "desconto"),
    "dependentes": ("dependente", "filho", "cônjuge", "companheiro", "alimentando"),
    "rendimentos": ("rendimento", "renda", "salário", "trabalho", "aposentadoria"),
    "prazo": ("prazo", "data", "quando", "período", "entrega"),
    "penalidades": ("multa", "penalidade", "sanção", "infração"),
    "isencao": ("isento", "isenção", "dispensado", "não tributado"),
    "aliquota": ("alíquota", "percentual", "taxa", "imposto"),
    "retificacao": ("retificar", "corrigir", "alterar", "retificadora"),
    "restituicao": ("restituição", "restituir", "devolver", "receber de volta"),
}
KINDS = {
    "procedimental": ("como", "proceder", "forma", "prazo", "quando", "onde"),
    "factual": ("quais", "quem", "qual a lei", "o que diz"),
    "conceitual": ("por que", "motivo", "razão", "explicação"),
}
TECHNICAL = ("cômputo", "não obstante", "ressalvado", "ex vi", "ipso facto")
FLAGS = {
    "has_examples": ("exemplo", "por exemplo", "ex:", "como:", "no caso"),
    "has_conditions": ("desde que", "exceto", "salvo", "ressalvado", "caso", "hipótese"),
    "has_references": ("art.", "artigo"),
}
ENUMERATIONS = ("i.", "ii.", "iii.", "1.", "2.", "3.")
ORGANIZATIONS = ("RFB", "Receita Federal", "PGFN", "e-CAC", "DARF", "Simples Nacional")
TAXES = ("IRRF", "IRPF", "IRPJ", "COFINS", "PIS", "Imposto de Renda")
LAW = r"(?iU)Lei\s*n[oº]?\s*(?:\.?\s*n\.?\s*)?(\d+[\d\./\s]*)(?:,?\s*de\s*\d{4})?"
CITED = r"(?iU)\b(?:artigo|art\.?|art|§)\s*(?:n[ºo]?\s*)?(\d+[A-Za-z0-9\-ºª]*)"
VALUES, DATES = r"R\$\s*[\d.,]+", r"(?U)\d{1,2}\s+de\s+\w+\s+de\s+\d{4}|\d{4}|ano-calendário\s+de\s+\d{4}"


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))


def _ordered(x: Column, rules: dict[str, tuple[str, ...]], other: str) -> Column:
    out = F.lit(other)
    for name, words in reversed(rules.items()):
        out = F.when(_any(x, words), F.lit(name)).otherwise(out)
    return out


def category(question: Column) -> Column:
    """The first category of which a word stands in the question."""
    return _ordered(F.lower(question), CATEGORIES, "outros")


def kind(question: Column) -> Column:
    return _ordered(F.lower(question), KINDS, "geral")


def complexity(question: Column) -> Column:
    n = word_count(question)
    return F.when(n <= 12, "simple").when(n <= 25, "medium").otherwise("complex")


def difficulty(question: Column, answer: Column) -> Column:
    """Easy if both are short; hard if the answer is long, makes several exceptions or has technical terms."""
    q, a = word_count(question), word_count(answer)
    twice = lambda w: F.regexp_count(answer, F.lit(w)) > 1
    return F.when((q < 10) & (a < 50), "facil").when((a > 150) | twice("desde que") | twice("exceto") | _any(F.lower(answer), TECHNICAL), "dificil").otherwise("medio")


def answer_flags(answer: Column) -> dict[str, Column]:
    low = F.lower(answer)
    return {k: _any(low, v) for k, v in FLAGS.items()} | {"has_enumerations": _any(answer, ENUMERATIONS)}


def entities(text: Column) -> dict[str, Column]:
    """Sorted distinct organisations, taxes, amounts and dates of a text."""
    held = lambda names: F.filter(F.array(*map(F.lit, sorted(names))), lambda n: F.contains(text, n))
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))))
    return {"organizations": held(ORGANIZATIONS), "tax_types": held(TAXES), "monetary_values": found(VALUES), "dates": found(DATES)}


def laws(text: Column) -> Column:
    """array<struct<law, articles>>: the articles cited from each law's name up to the next one's; without laws all articles under one general name."""
    cited = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(CITED), F.lit(1))))
    names = F.transform(F.regexp_extract_all(text, F.lit(LAW), F.lit(0)), lambda n: F.regexp_replace(F.regexp_replace(strip(n), r"[.,;]+\z", ""), r"(?U)\s+", " "))
    behind = F.split(text, LAW, -1)
    pairs = F.transform(names, lambda n, i: F.struct(n.alias("law"), F.regexp_extract_all(F.get(behind, i + 1), F.lit(CITED), F.lit(1)).alias("articles")))
    own = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("law"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(pairs, lambda p: p["law"] == n), lambda p: p["articles"])))).alias("articles")))
    loose = F.when(F.size(cited(text)) > 0, F.array(F.struct(F.lit("Legislação Citada").alias("law"), cited(text).alias("articles"))))
    return F.when(F.size(names) > 0, own).otherwise(F.coalesce(loose, F.filter(own, lambda _: F.lit(False))))


def position(text: Column) -> dict[str, Column]:
    """First article, paragraph and clause that an answer names; null without."""
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return {"article": first(r"(?i)art(?:igo)?\.?\s*(\d+)[ºª°]?"), "paragraph": first(r"§\s*(\d+)[ºª°]?"), "clause": first(r"(?i)inciso\s+([IVX]+)")}


def labels(question: Column, answer: Column) -> dict[str, Column]:
    """All labels of a pair by name."""
    return {"category": category(question), "kind": kind(question), "complexity": complexity(question), "difficulty": difficulty(question, answer)} | answer_flags(answer) | {"question_laws": laws(question), "answer_laws": laws(answer)} | entities(F.concat_ws(" ", question, answer)) | position(answer)
