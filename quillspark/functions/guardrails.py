"""Checks of questions and answers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import slices

# Kinds of personal data with pattern and confidence.
PII = {
    "cpf": (r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", 0.9),
    "cnpj": (r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", 0.9),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    "phone": (r"\b(?:\+55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}-?\d{4}\b", 0.8),
    "credit_card": (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", 0.7),
    "cep": (r"\b\d{5}-?\d{3}\b", 0.85),
    "rg": (r"\b\d{1,2}\.?\d{3}\.?\d{3}-?[0-9xX]\b", 0.75),
}
SENSITIVITY = {"low": 0.9, "medium": 0.7, "high": 0.5}
#: Bytes of texts that are Python strings at a time, with what was made of them.
SLICE = 1 << 20
# Attempts at overriding instructions, and offensive requests.
INJECTION = (
    r"ignore\s+(previous|above|prior)\s+instructions?", r"disregard\s+(previous|above|prior)\s+instructions?", r"forget\s+(previous|above|prior)\s+instructions?",
    r"you\s+are\s+now\s+a", r"act\s+as\s+a", r"pretend\s+to\s+be",
    r"show\s+me\s+your\s+(instructions|prompt|system)", r"what\s+(are|is)\s+your\s+(instructions|prompt|system)", r"repeat\s+your\s+(instructions|prompt)",
    r"DAN\s+mode", r"developer\s+mode", r"sudo\s+mode", r"<\s*script\s*>", r"javascript:", r"eval\s*\(", r"(?:';|--;|\bOR\b\s+\d+\s*=\s*\d+)",
)
OFFENSIVE = (r"\b(?:burlar|enganar|fraudar)\s+(?:sistema|receita)", r"\b(?:sonegar|evadir)\s+imposto", r"\blavagem\s+de\s+dinheiro\b")
CHARSET = r"^[\w\s\.,;:!?()\-áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ\/\[\]]+$"
# Hedging, honest statements of not knowing, citations, words that a question's topic isn't in, disclaimers, empty phrases.
HEDGES = (r"\b(?:não tenho certeza|não sei ao certo|acho que|talvez)\b", r"\b(?:pode ser que|possivelmente|provavelmente)\b", r"\b(?:conforme meu conhecimento|até onde sei)\b", r"\b(?:não consigo confirmar|não posso garantir)\b")
HONEST = (r"não encontrei (?:essa informação|esses dados)", r"não há informação disponível", r"não consta nos documentos", r"não está presente no contexto")
CITATIONS = (r"(?:Art\.?|Artigo)\s*\d+", r"§\s*\d+º?", r"(?:Lei|Decreto|Instrução Normativa)\s+(?:nº?\s*)?\d+", r"IN\s+RFB\s+(?:nº?\s*)?\d+")
QUESTION_WORDS = ("qual", "quais", "como", "onde", "quando", "porque", "para", "sobre", "pode", "posso", "devo", "isso", "esse", "aquele")
DISCLAIMERS = ("⚠️", "importante:", "aviso:", "consulte um", "busque orientação", "não constitui consultoria")
GENERIC = ("depende do caso", "varia de acordo", "consulte um especialista", "entre em contato", "não posso fornecer")


def _any(x: Column, patterns, flags: str = "(?iU)") -> Column:
    return reduce(lambda a, b: a | b, (x.rlike(flags + p) for p in patterns))


def kinds(sensitivity: str = "medium") -> list[str]:
    return [k for k, (_, c) in PII.items() if c >= SENSITIVITY[sensitivity]]


def pii_counts(x: Column, sensitivity: str = "medium") -> dict[str, Column]:
    """How often each kind occurs. A text without what all matches of a kind hold, @ or three digits, is not searched."""
    digits = x.rlike("[0-9]{3}")
    return {k: F.when(F.contains(x, F.lit("@")) if k == "email" else digits, F.regexp_count(x, F.lit(PII[k][0]))).otherwise(F.when(x.isNotNull(), F.lit(0))).cast("long") for k in kinds(sensitivity)}


def has_pii(x: Column, sensitivity: str = "medium") -> Column:
    return _any(x, (PII[k][0] for k in kinds(sensitivity)), "")


def _each(f: Callable[[str], object], kind: str, arrow: pa.DataType):
    """A function of a text column: f of each text (null: null), given back SLICE bytes of texts at a time."""

    @F.arrow_udf(kind)
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            for part in slices(pa.RecordBatch.from_arrays([x], ["x"]), "x", SLICE):
                yield pa.array([None if t is None else f(t) for t in part.column("x").to_pylist()], arrow)

    return each


def pii_matches(sensitivity: str = "medium"):
    """A function of a text column: array of (type, value, start, end, confidence) by start; types may overlap."""
    import re

    found = [(k, re.compile(PII[k][0]), PII[k][1]) for k in kinds(sensitivity)]
    fields = pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])

    def matches(t: str) -> list[dict]:
        return sorted(({"type": k, "value": m[0], "start": m.start(), "end": m.end(), "confidence": c} for k, p, c in found for m in p.finditer(t)), key=lambda m: m["start"])

    return _each(matches, "array<struct<type: string, value: string, start: int, end: int, confidence: double>>", pa.list_(fields))


def redactor(how: str | Sequence[str] = "type", sensitivity: str = "medium"):
    """A function of a text column: personal data replaced by its type, a word (generic), its tail (partial) or as many stars (mask).

    Overlapping matches are replaced as one, by the rule of the first. Several ways give a struct with a field for
    each; a text is searched once for all of them.
    """
    import re

    found = [(k, re.compile(PII[k][0])) for k in kinds(sensitivity)]

    def one(how: str, kind: str, value: str) -> str:
        if how == "mask":
            return "*" * len(value)
        if how != "partial":
            return f"[{kind.upper()}]" if how == "type" else "[REDACTED]"
        digits = re.sub(r"\D", "", value)
        return "***@" + value.split("@")[1] if kind == "email" and "@" in value else "***" + digits[-4:] if kind in ("cpf", "cnpj", "phone") and len(digits) >= 4 else "***"

    def spans(t: str) -> list[tuple[int, int, str]]:
        return sorted((m.start(), m.end(), k) for k, p in found for m in p.finditer(t))

    def redact(how: str, t: str, places: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for start, end, kind in places:
            if start >= at:
                out += [t[at:start], one(how, kind, t[start:end])]
            elif end > at and how == "mask":
                out.append("*" * (end - at))
            at = max(at, end)
        return "".join([*out, t[at:]])

    if isinstance(how, str):
        return _each(lambda t: redact(how, t, spans(t)), "string", pa.string())

    def ways(t: str) -> dict[str, str]:
        places = spans(t)
        return {h: redact(h, t, places) for h in how}

    return _each(ways, f"struct<{', '.join(f'`{h}`: string' for h in how)}>", pa.struct([(h, pa.string()) for h in how]))


def repetitive(x: Column) -> Column:
    return x.rlike(r"(?s)(.)\1{9,}")


def sanitized(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1F]", ""), r"(?U)\A\s+|\s+\z", "")


def validate_input(x: Column, least: int = 3, most: int = 2000) -> Column:
    """struct of is_valid, errors, warnings, sanitized."""
    x = F.coalesce(x, F.lit(""))
    empty = F.regexp_replace(x, r"(?U)\s+", "") == ""
    errors = F.array_compact(F.array(F.when(F.length(x) < least, F.lit("short")), F.when(F.length(x) > most, F.lit("long")), F.when(has_pii(x), F.lit("pii")), F.when(_any(x, INJECTION), F.lit("injection")), F.when(_any(x, OFFENSIVE), F.lit("offensive"))))
    errors = F.when(empty, F.array(F.lit("empty"))).otherwise(errors)
    warnings = F.array_compact(F.array(F.when(~empty & ~x.rlike("(?U)" + CHARSET), F.lit("charset")), F.when(~empty & repetitive(x), F.lit("repetition"))))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"), F.when(F.size(errors) == 0, sanitized(x)).alias("sanitized"))


def citations(x: Column) -> Column:
    return F.concat(*(F.regexp_extract_all(x, F.lit("(?iU)" + p), F.lit(0)) for p in CITATIONS))


def citation_accuracy(found: Column, context: Column) -> Column:
    """Share of citations that the context holds, without spaces and case; 1 without citations."""
    plain = F.replace(F.lower(context), F.lit(" "), F.lit(""))
    return F.when(F.size(found) == 0, F.lit(1.0)).otherwise(F.size(F.filter(found, lambda c: F.contains(plain, F.replace(F.lower(c), F.lit(" "), F.lit(""))))) / F.size(found))


def honest(x: Column) -> Column:
    return _any(x, HONEST)


def hallucination_risk(x: Column) -> Column:
    words = F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    hits = reduce(lambda a, b: a + b, (F.regexp_count(x, F.lit("(?iU)" + p)) for p in HEDGES))
    return F.when(honest(x) | (words == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), hits / words * 100 / 5))


def relevant(response: Column, query: Column) -> Column:
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*QUESTION_WORDS)))
    low = F.lower(response)
    return (F.size(found) == 0) | (F.size(F.filter(found, lambda w: F.contains(low, w))) / F.size(found) > 0.3)


def quality_score(x: Column, has_citations: Column, accuracy: Column, risk: Column, is_relevant: Column) -> Column:
    n = F.length(x)
    score = F.lit(0.5) + F.when(has_citations, 0.2 * accuracy).otherwise(0.0) + F.when(is_relevant, 0.15).otherwise(0.0) + F.when(n.between(50, 1500), 0.15).when(n > 1500, 0.05).otherwise(0.0) - 0.3 * risk
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _count(x: Column, phrases) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(F.lower(x), F.lit(p)).cast("int") for p in phrases))


def has_disclaimer(x: Column) -> Column:
    return _count(x, DISCLAIMERS) > 0


def is_generic(x: Column) -> Column:
    return (_count(x, GENERIC) >= 2) & (F.length(x) < 200)


def validate_output(response: Column, query: Column, context: Column, least_quality: float = 0.6) -> Column:
    """struct of is_valid, errors, warnings, quality_score, has_citations, citation_accuracy, is_relevant, hallucination_risk; context: all chunks, joined."""
    found = citations(response)
    cited, no_context = F.size(found) > 0, F.coalesce(context, F.lit("")) == ""
    accuracy = F.when(no_context | ~cited, F.lit(1.0)).otherwise(citation_accuracy(found, context))
    risk, fits = hallucination_risk(response), relevant(response, query)
    quality = quality_score(response, cited, accuracy, risk, fits)
    errors = F.array_compact(F.array(F.when(F.length(response) < 20, F.lit("short")), F.when(risk > 0.5, F.lit("hallucination")), F.when(quality < least_quality, F.lit("quality"))))
    warnings = F.array_compact(F.array(F.when(F.length(response) > 3000, F.lit("long")), F.when(~cited & ~honest(response), F.lit("no citation")), F.when(cited & ~no_context & (accuracy < 0.8), F.lit("citation")), F.when((risk > 0.3) & (risk <= 0.5), F.lit("hedging")), F.when(~fits, F.lit("relevance")), F.when(is_generic(response), F.lit("generic"))))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"), quality.alias("quality_score"), cited.alias("has_citations"), accuracy.alias("citation_accuracy"), fits.alias("is_relevant"), risk.alias("hallucination_risk"))
