"""The audit of processed documents (L13): a row of measures for each text, from its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings, articles, list items, anchors and links of generated Markdown; signs of a wrong encoding.
HEADING, HEADING_ARTICLE = r"^(#{1,6})\s+", r"^#{1,6}\s+Art\."
BOLD, CLAUSE, LETTER = r"^\*\*(?:§|Parágrafo)", r"^-\s+[IVX]+\s+-", r"^\s{2}-\s+[a-z]\)"
ANCHOR, LINK = r"\{#art-([^}]+)\}", r"\[Art\.\s*[^\]]+\]\(#art-([^)]+)\)"
WRONG = (r"Ã[§çÃÂÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ]", r"n[Ãâ][°º]", r"seÃ", r"aÃ")


def lines_of(text: Column) -> Column:
    """Lines without their ends; an end at the end of the text doesn't begin another."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def _blank(x: Column) -> Column:
    return ~x.rlike(r"(?U)\S")


def kind_of(line: Column) -> Column:
    """1 to 6 for headings (with an A for articles), b, c, l for bold, clause and letter, a blank for blank lines, t for text, empty for others. A line's first characters tell which patterns it can match."""
    level = F.length(F.regexp_extract(line, HEADING, 1)).cast("string")
    return (
        F.when(line.startswith("#") & line.rlike(HEADING), F.concat(level, F.when(line.rlike(HEADING_ARTICLE), "A").otherwise(""))).when(line.startswith("**") & line.rlike(BOLD), "b").when(line.startswith("-") & line.rlike(CLAUSE), "c")
        .when((F.substring(line, 3, 1) == "-") & line.rlike(LETTER), "l").when(_blank(line), " ").when(line.startswith("<") | line.startswith("|"), "").otherwise("t")
    )


def audit(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures of each text: each line is looked at once, as the first of heading, bold, clause, letter and body that it is."""
    rows = docs.select(id, F.coalesce(F.col(text), F.lit("")).alias("x"))
    rows = rows.withColumn("kinds", F.when(F.col("x") == "", F.array().cast("array<string>")).otherwise(F.transform(lines_of(F.col("x")), kind_of)))
    rows = rows.withColumns({"anchors": F.array_distinct(F.regexp_extract_all("x", F.lit(ANCHOR), F.lit(1))), "links": F.array_distinct(F.regexp_extract_all("x", F.lit(LINK), F.lit(1)))})
    wrong = F.concat(*(F.slice(F.regexp_extract_all("x", F.lit(p), F.lit(0)), 1, 3) for p in WRONG))
    rows = rows.withColumn("wrong", F.when(F.contains("x", F.lit("Ã")) | F.contains("x", F.lit("â")), wrong).otherwise(F.array().cast("array<string>")))
    count = lambda on: F.size(F.filter("kinds", on)).cast("long")
    run = F.aggregate("kinds", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, k: F.struct(F.when(k == " ", s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(k == " ", s["now"] + 1).otherwise(0)).alias("most")), lambda s: s["most"])
    begins, equals = lambda mark: lambda k: k.startswith(mark), lambda mark: lambda k: k == mark
    found = {f"h{i}": count(begins(str(i))) for i in range(1, 7)}
    found |= {"headings": count(lambda k: k.rlike("^[1-6]")), "articles": count(lambda k: k.endswith("A"))}
    found |= {name: count(equals(mark)) for name, mark in (("bold", "b"), ("clauses", "c"), ("letters", "l"), ("body_lines", "t"))}
    found |= {"lines": F.size("kinds").cast("long"), "anchors": F.size("anchors").cast("long"), "links": F.size("links").cast("long"), "broken_links": F.array_except("links", "anchors")}
    found |= {"mojibake": F.size("wrong") > 0, "mojibake_samples": F.slice("wrong", 1, 5), "blank_blocks": F.regexp_count("x", F.lit(r"\n{4,}")).cast("long"), "blank_run": run.cast("long")}
    found |= {"chars": F.length("x").cast("long"), "words": F.regexp_count("x", F.lit(r"(?U)\S+")).cast("long"), "sha256": F.sha2(F.col("x").cast("binary"), 256)}
    return rows.select(id, *(c.alias(k) for k, c in found.items()))
