"""Questions and answers: kind of question, what an answer states, lexical scores against its context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each kind of question, in order of priority.
QUERY_TYPES = {
    "deductions": ("dedução", "deduzir", "abater", "desconto", "despesa"),
    "calculation": ("calcular", "cálculo", "quanto", "valor", "alíquota", "imposto devido"),
    "deadlines": ("prazo", "data", "quando", "entregar", "multa", "atraso"),
    "income": ("rendimento", "salário", "renda", "tributável", "isento", "carnê-leão"),
    "dependents": ("dependente", "filho", "alimentando", "cônjuge", "incluir dependente"),
}
MONEY, PERCENT, DATE = r"R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)", r"(\d+(?:,\d+)?)\s*%", r"\d{1,2}/\d{1,2}/\d{4}"
# Words that aren't keywords.
STOPWORDS = ("qual", "quais", "como", "onde", "quando", "porque", "para", "sobre", "pode", "posso", "devo", "isso", "esse", "aquele", "esta", "este", "pela", "pelo", "com", "sem", "mais", "menos")


def query_type(x: Column) -> Column:
    """The kind with most words in the question, the first of equals; rag_default without any."""
    low = F.lower(x)
    score = {k: reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in v)) for k, v in QUERY_TYPES.items()}
    best = F.greatest(*score.values())
    out = F.lit("rag_default")
    for k in reversed(score):
        out = F.when((score[k] == best) & (best > 0), F.lit(k)).otherwise(out)
    return out


# Citations that an evaluation counts.
CITED = (r"(?:Art\.?|Artigo)\s*\d+", r"§\s*\d+", r"(?:Lei|IN)\s+(?:nº?\s*)?\d+")


def cited(answer: Column, context: Column) -> dict[str, Column]:
    """has_citations, citation_count, accuracy: the share of citations, spaces kept, that the context holds; 1 without citations."""
    found = F.concat(*(F.regexp_extract_all(answer, F.lit("(?iU)" + p), F.lit(0)) for p in CITED))
    low = F.lower(context)
    held = F.size(F.filter(found, lambda c: F.contains(low, F.lower(c))))
    return {"has_citations": F.size(found) > 0, "citation_count": F.size(found), "accuracy": F.when(F.size(found) == 0, F.lit(1.0)).otherwise(held / F.size(found))}


def _number(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def money(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(MONEY), F.lit(1)), _number)


def percentages(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(PERCENT), F.lit(1)), _number)


def dates(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(DATE), F.lit(0))


def key_terms(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))))


def keywords(x: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS)))


def answer_relevance(answer: Column, question: Column) -> Column:
    found, low = keywords(question), F.lower(answer)
    return F.when(F.size(found) == 0, F.lit(1.0)).otherwise(F.size(F.filter(found, lambda w: F.contains(low, w))) / F.size(found))


def context_relevance(chunks: Column, question: Column) -> Column:
    found = keywords(question)
    good = F.filter(chunks, lambda c: F.size(F.filter(found, lambda w: F.contains(F.lower(c), w))) / F.size(found) > 0.3)
    return F.when(F.size(chunks) == 0, F.lit(0.0)).when(F.size(found) == 0, F.lit(1.0)).otherwise(F.size(good) / F.size(chunks))


def _sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")), lambda s: F.length(s) > 10)


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's sentences of which more than half the word trigrams stand in the context."""
    low = F.lower(context)

    def faithful(s: Column) -> Column:
        w = F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")
        grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))
        return F.coalesce(F.size(F.filter(grams, lambda g: F.contains(low, g))) / F.size(grams) > 0.5, F.lit(False)) & (F.size(w) >= 3)

    s = _sentences(F.lower(answer))
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.filter(s, faithful)) / F.size(s))


def hallucination(answer: Column, context: Column) -> Column:
    """Share of the answer's claims of which under two fifths of the important terms stand in the context; claims without terms count as supported."""
    low = F.lower(context)

    def unsupported(s: Column) -> Column:
        terms = F.concat(F.regexp_extract_all(s, F.lit(r"\b\d+(?:[.,]\d+)?\b"), F.lit(0)), F.regexp_extract_all(s, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0)), F.filter(F.split(s, r"(?U)\s+"), lambda w: F.length(w) > 6))
        return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))), F.size(terms)) < 0.4, F.lit(False))

    s = F.filter(_sentences(answer), lambda t: ~F.endswith(t, F.lit("?")))
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.filter(s, unsupported)) / F.size(s))


def retrieval_scores(retrieved: Column, relevant: Column) -> dict[str, Column]:
    """Precision, recall, F1 and reciprocal rank of the first relevant one; ids as arrays, retrieved by rank."""
    both = F.size(F.array_intersect(retrieved, relevant))
    p = F.when(F.size(retrieved) == 0, F.lit(0.0)).otherwise(both / F.size(F.array_distinct(retrieved)))
    r = F.when(F.size(relevant) == 0, F.lit(1.0)).otherwise(both / F.size(F.array_distinct(relevant)))
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull()))
    return {"precision": p, "recall": r, "f1": F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), "mrr": F.coalesce(1 / first, F.lit(0.0))}


def overall(p: Column, r: Column, f: Column, ar: Column, cr: Column, h: Column) -> Column:
    return 0.15 * p + 0.15 * r + 0.25 * f + 0.20 * ar + 0.15 * cr + 0.10 * (1 - h)
