"""Answers of a model: cleaning, core text, citations, confidence, warnings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import dates, key_terms, money, percentages
from .text import strip

# Articles and paragraphs cited, phrases that answers use, openings and endings that aren't the answer.
ARTICLE, PARAGRAPH = r"(?iU)(?:Art\.?|Artigo)\s*(\d+(?:-[A-Z])?)(?=(.{0,50}))", r"(?U)§\s*(\d+º?)"
NO_INFORMATION = ("não encontrei", "não há informação", "não consta", "não está presente", "não disponível", "informação ausente")
CLARIFY = ("poderia esclarecer", "preciso de mais informações", "qual especificamente", "você pode especificar", "preciso saber")
UNCERTAIN = ("talvez", "possivelmente", "provavelmente", "pode ser")
LEGAL_WORDS = ("art.", "artigo", "lei", "decreto", "§")
OPENINGS = (r"Prezado\(a\)\s+usuário\(a\),?\s*\n+", r"Prezado\(a\)\s+contribuinte,?\s*\n+", r"Caro\(a\)\s+usuário\(a\),?\s*\n+", r"Olá,?\s*\n+", r"Agradeço\s+sua\s+pergunta[^\n]*\n+", r"Como assistente especializado[^:,]+[,:]\s+", r"Como especialista[^:,]+[,:]\s+")
ENDINGS = ("⚠️", "Importante:", "Observação:")


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))


def cleaned(x: Column) -> Column:
    """White space as single blanks; numbers of chunks that leaked go."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "), r"\[Trecho \d+\]", ""))


def core(x: Column) -> Column:
    """Without greetings, thanks and introductions before, and remarks behind the answer."""
    for opening in OPENINGS:
        x = F.regexp_replace(x, r"(?isU)\A" + opening, "")
    for ending in ENDINGS:
        x = F.regexp_replace(x, r"(?isU)\n+" + ending + r".*\z", "")
    return strip(x)


def citations(x: Column) -> Column:
    """array<struct<article, paragraph>>: each article, with the first paragraph in the 50 characters behind it (null without)."""
    numbers, behind = (F.regexp_extract_all(x, F.lit(ARTICLE), F.lit(i)) for i in (1, 2))
    paragraph = lambda t: F.nullif(F.regexp_extract(t, PARAGRAPH, 1), F.lit(""))
    return F.zip_with(numbers, behind, lambda n, t: F.struct(F.concat(F.lit("Art. "), n).alias("article"), F.concat(F.lit("§ "), paragraph(t)).alias("paragraph")))


def confidence(x: Column) -> Column:
    """A half, more for citations, numbers and a fair length, less for doubt and missing information; within 0 and 1."""
    return _let(_read(x), _confidence)


def _confidence(v: Column) -> Column:
    gain = lambda on, by: F.when(on, F.lit(by)).otherwise(0.0)
    numbers = (F.size(v["money"]) > 0) | (F.size(v["percentages"]) > 0)
    score = 0.5 + gain(F.size(v["citations"]) > 0, 0.2) + gain(numbers, 0.1) + gain(F.length(v["x"]).between(50, 1000), 0.1) - gain(_any(v["low"], UNCERTAIN), 0.2) - gain(_any(v["low"], NO_INFORMATION), 0.3)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def has_answer(x: Column) -> Column:
    return ~_any(F.lower(x), NO_INFORMATION) & (F.length(x) >= 30)


def needs_clarification(x: Column) -> Column:
    return _any(F.lower(x), CLARIFY)


def warnings(x: Column) -> Column:
    return _let(_read(x), _warnings)


def _warnings(v: Column) -> Column:
    x, low, none = v["x"], v["low"], F.size(v["citations"]) == 0
    doubts = F.regexp_count(low, F.lit("talvez")) + F.regexp_count(low, F.lit("possivelmente"))
    rules = (
        (F.length(x) < 20, "Resposta muito curta"), (F.length(x) > 2000, "Resposta muito longa"),
        (_any(low, LEGAL_WORDS) & none, "Menciona legislação mas não cita artigos específicos"),
        ((F.size(v["money"]) > 0) & none, "Menciona valores mas sem referência legal"), (doubts > 2, "Muitas expressões de incerteza"),
    )
    return F.array_compact(F.array(*(F.when(on, F.lit(said)) for on, said in rules)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _read(x: Column) -> Column:
    """x, its lower case and what patterns find in it."""
    return F.struct(x.alias("x"), F.lower(x).alias("low"), citations(x).alias("citations"), money(x).alias("money"), percentages(x).alias("percentages"))


#: What is read of an answer, by name, from what _read finds in it.
PARTS: dict[str, Callable[[Column], Column]] = {
    "clean_text": lambda v: v["x"], "citations": lambda v: v["citations"], "monetary_values": lambda v: v["money"], "percentages": lambda v: v["percentages"],
    "dates": lambda v: dates(v["x"]), "articles": lambda v: F.array_sort(F.array_distinct(F.transform(v["citations"], lambda c: c["article"]))),
    "key_terms": lambda v: key_terms(v["x"]), "confidence": _confidence, "has_answer": lambda v: has_answer(v["x"]),
    "needs_clarification": lambda v: needs_clarification(v["x"]), "warnings": _warnings,
}


def parse(x: Column, *parts: str) -> Column:
    """struct of the parts (all by default) of the raw text of an answer, whose patterns are sought once; a null text is an empty one."""
    return _let(cleaned(x), lambda t: _let(_read(t), lambda v: F.struct(*(PARTS[k](v).alias(k) for k in parts or PARTS))))


def parsed(x: Column) -> dict[str, Column]:
    """The parts as columns of their own; where several are asked for, parse reads the text once for all."""
    return {k: parse(x, k)[k] for k in PARTS}
