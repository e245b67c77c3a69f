"""Prompts as Column expressions: a template for each kind of question, numbered context, examples.

The wording is this package's own; names, slots and the numbering of chunks are those that callers rely on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import query_type

SYSTEM = "Você responde a perguntas sobre o imposto de renda da pessoa física. Apoie-se somente nos trechos dados, cite artigos e parágrafos, e diga quando a informação não estiver neles."
ALONE = "Você responde a perguntas sobre o imposto de renda da pessoa física com o que sabe da legislação. Cite artigos quando couber."

#: name: (focus of the system text, user text with {context} and {query})
TEMPLATES = {
    "rag_default": ("", "Trechos:\n{context}\n\nPergunta: {query}\n\nResponda só com base nos trechos."),
    "deductions": ("Assunto: deduções, seus limites e comprovantes.", "Trechos sobre deduções:\n{context}\n\nPergunta: {query}\n\nDiga quais deduções valem, até quanto e com que condições."),
    "calculation": ("Assunto: cálculo do imposto. Mostre cada passo.", "Trechos sobre cálculo:\n{context}\n\nCaso: {query}\n\nCalcule passo a passo."),
    "deadlines": ("Assunto: prazos, pagamentos e multas.", "Trechos sobre prazos:\n{context}\n\nPergunta: {query}\n\nDê as datas e o que ocorre com o atraso."),
    "income": ("Assunto: rendimentos tributáveis, isentos e exclusivos.", "Trechos sobre rendimentos:\n{context}\n\nPergunta: {query}\n\nDiga como declarar e tributar esse rendimento."),
    "dependents": ("Assunto: dependentes e alimentandos.", "Trechos sobre dependentes:\n{context}\n\nPergunta: {query}\n\nDiga as regras e as deduções por dependente."),
    "general": ("", "{query}\n\nResponda com clareza e em ordem."),
}
DESCRIPTIONS = {"rag_default": "perguntas com contexto", "deductions": "deduções", "calculation": "cálculos", "deadlines": "prazos", "income": "rendimentos", "dependents": "dependentes", "general": "perguntas sem contexto"}


def system(name: str) -> str:
    """The system text of a template; unknown names take that of rag_default."""
    focus = TEMPLATES.get(name, TEMPLATES["rag_default"])[0]
    return f"{SYSTEM}\n\n{focus}" if focus else SYSTEM


def numbered(chunks: Column) -> Column:
    """[Trecho 1] and so on before each chunk."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("[Trecho "), (i + 1).cast("string"), F.lit("]\n"), c)), "\n\n")


def fill(template: str, query: Column, context: Column) -> Column:
    """The template with its slots filled; braces inside query and context stay as they are."""
    parts = []
    for piece in template.replace("{context}", "\0{context}\0").replace("{query}", "\0{query}\0").split("\0"):
        parts.append(context if piece == "{context}" else query if piece == "{query}" else F.lit(piece))
    return F.concat(*parts)


def _none(*columns: Column) -> list[Column]:
    return [F.coalesce(c, F.lit("")) for c in columns]


def render(name: Column, query: Column, context: Column) -> Column:
    """The whole prompt by a template's name in a column."""
    query, context = _none(query, context)
    whole = lambda n: F.concat(F.lit(system(n) + "\n\n"), fill(TEMPLATES[n][1], query, context))
    out = whole("rag_default")
    for n in TEMPLATES:
        if n != "rag_default":
            out = F.when(name == n, whole(n)).otherwise(out)
    return out


def with_context(query: Column, chunks: Column) -> Column:
    return render(query_type(query), query, numbered(F.coalesce(chunks, F.array().cast("array<string>"))))


def without_context(query: Column) -> Column:
    return F.concat(F.lit(f"{ALONE}\n\nPergunta: "), *_none(query), F.lit("\n\nResposta:"))


def few_shot(query: Column, chunks: Column, examples: Column) -> Column:
    """examples: array<struct<question, answer>>."""
    one = lambda e, i: F.concat(F.lit("Exemplo "), (i + 1).cast("string"), F.lit(":\nPergunta: "), e["question"], F.lit("\nResposta: "), e["answer"])
    return F.concat(F.lit(SYSTEM + "\n\n"), F.array_join(F.transform(examples, one), "\n\n---\n\n"), F.lit("\n\n---\n\nContexto:\n"), numbered(chunks), F.lit("\n\nPergunta: "), query, F.lit("\n\nResposta:"))


def display(text: Column, citations: Column, warnings: Column) -> Column:
    """The answer's text, its references (array<struct<article, paragraph>>) and remarks as Markdown lists."""
    refs = F.transform(citations, lambda c: F.concat(F.lit("- "), F.concat_ws(", ", c["article"], c["paragraph"]), F.lit("\n")))
    said = F.transform(warnings, lambda w: F.concat(F.lit("- "), w, F.lit("\n")))
    part = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n{title}\n"), F.array_join(items, ""))).otherwise("")
    return F.concat(text, part("📚 **Referências:**", refs), part("⚠️ **Observações:**", said))


def history(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """id, n_turns, turns (array of role, text in order; the role assistant is called model), last_text, prompt: the turns before the last one, and it."""
    name = F.when(F.col(role) == "assistant", "model").otherwise(F.col(role))
    out = rows.groupBy(id).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), name.alias("role"), F.col(text).alias("text")))).alias("t"))
    out = out.select(id, F.size("t").alias("n_turns"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    said = F.array_join(F.transform(F.slice("turns", F.lit(1), F.size("turns") - 1), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    last = F.element_at("turns", -1)["text"]
    return out.select("*", last.alias("last_text"), F.concat_ws("\n\n", F.nullif(said, F.lit("")), F.concat(F.lit("Pergunta: "), F.coalesce(last, F.lit("")))).alias("prompt"))
