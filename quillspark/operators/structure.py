"""Structure of legal and Markdown texts from their lines: window functions over (document, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings of each level, starts of articles, ends of their text, references to laws.
LEVELS = {
    "livro": r"^###\s+(LIVRO\s+[IVXLCDM]+.*?)$",
    "titulo": r"^####\s+(TÍTULO\s+[IVXLCDM]+.*?)$",
    "capitulo": r"^#####\s+(CAPÍTULO\s+[IVXLCDM0-9]+.*?)$",
    "secao": r"(?iu)^######\s+(Se[çc][ãa]o\s+[IVXLCDM0-9]+.*?)$",
    "subsecao": r"(?iu)^\*\s+\*\*(Subse[çc][ãa]o\s+.*?)\*\*$",
}
ARTICLE = r"^(?:##\s*|\s*\*\s*)Art\.?\s*(\d+(?:\.\d{3})*)"
STOP = r"(?iu)^#{1,6}\s+(?:ANEXO|LIVRO|TÍTULO|CAPÍTULO|Se[çc][ãa]o)\s+"
FOOTER = r"^#{5}\s+(?:Este texto não substitui|\*?\s*Publicad[oa]|Texto compilado)"
ANNEX = r"^##\s+ANEXO\s+"
REFERENCES = (r"(?iu)Lei n[º°]\s*[\d.,]+(?:/\d{2,4})?", r"(?iu)Decreto n[º°]\s*[\d.,]+(?:/\d{2,4})?", r"(?iu)(?:Instrução Normativa|IN)\s+(?:RFB\s+)?n[º°]\s*[\d.,]+(?:/\d{2,4})?")


def line_class(line: Column) -> Column:
    """chapter, section, article, paragraph, title (short, in capitals) or null."""
    up = F.upper(line)
    capitals = (up == line) & (F.lower(line) != line)
    return (
        F.when(up.rlike(r"^CAP[ÍI]TULO\s+[IVXLCDM]+"), "chapter").when(up.rlike(r"^SE[ÇC][ÃA]O\s+[IVXLCDM]+"), "section").when(up.rlike(r"^ART\.?\s+\d+"), "article")
        .when(line.rlike(r"^§\s*\d+"), "paragraph").when((F.length(line) < 100) & capitals & ~line.startswith("ART") & ~line.startswith("§"), "title")
    )


def lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(id, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def markdown_sections(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 100) -> DataFrame:
    """id, section, title, content: a heading of level two or more starts a section; short sections are left out."""
    rows = lines(docs, id, text).withColumn("head", F.regexp_extract("line", r"^##+\s+(.+)", 1))
    rows = rows.withColumn("section", F.sum((F.col("head") != "").cast("int")).over(Window.partitionBy(id).orderBy("pos")))
    out = rows.groupBy(id, "section").agg(F.first(F.when(F.col("head") != "", F.trim("head")), True).alias("title"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    content = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"(?U)\A\s+|\s+\z", "")
    return out.select(id, "section", F.coalesce("title", F.lit("Introdução")).alias("title"), content.alias("content")).where(F.length("content") >= least)


def heading_sections(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, section, title, level, content of headings of all six levels; text before the first is left out; a text without headings is one section Documento of level 1."""
    rows = lines(docs, id, text).withColumns({"marks": F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1), "head": F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2))})
    rows = rows.withColumn("section", F.sum((F.col("marks") != "").cast("int")).over(Window.partitionBy(id).orderBy("pos")))
    # All lines of a text without headings are in section 0, which other texts lose.
    rows = rows.withColumn("last", F.max("section").over(Window.partitionBy(id))).where("section > 0 or last = 0")
    own = F.when(F.col("marks") == "", F.struct("pos", "line"))
    out = rows.groupBy(id, "section").agg(F.max(F.length("marks")).alias("level"), F.min_by("head", "pos").alias("title"), F.array_sort(F.collect_list(own)).alias("l"))
    content = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"(?U)\A\s+|\s+\z", "")
    none = F.col("section") == 0
    return out.select(id, F.greatest(F.col("section"), F.lit(1)).alias("section"), F.when(none, "Documento").otherwise(F.col("title")).alias("title"), F.when(none, 1).otherwise(F.col("level")).alias("level"), content.alias("content"))


# The outline of a generated text, its articles, a title without a number before an article.
OUTLINE = r"(?s)<details>\s*<summary>📋 Esquema da Legislação</summary>(.*?)</details>"
LISTED = r"^(?:##|\s*\*)\s*Art\.?\s*(\d+(?:\.\d{3})*)[º°]?(?:-[A-Z])?\s*$"
SUBTITLE = r"^\*\s+([A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][^*\n]{3,80})$"


def outline_articles(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, number, part: the articles that a text's outline lists, once for each part (preamble, annex), in order. Letters behind a number are left out."""
    rows = lines(docs.select(id, F.regexp_extract(text, OUTLINE, 1).alias("outline")), id, "outline")
    rows = rows.withColumn("annexed", F.max(F.col("line").rlike(ANNEX)).over(Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select(id, "pos", F.regexp_extract("line", LISTED, 1).alias("number"), F.when(F.col("annexed"), "anexo").otherwise("preambulo").alias("part")).where("number <> ''")
    first = rows.groupBy(id, "part", "number").agg(F.min("pos").alias("pos"))
    return first.select(id, F.row_number().over(Window.partitionBy(id).orderBy("pos")).alias("n"), "number", "part")


def subtitle(before: Column, most: int = 20) -> Column:
    """The nearest title without a number among the last lines before an article; one behind a heading or item that names an article, or a bold one, doesn't count."""
    last = F.reverse(F.slice(F.split(before, "\n", -1), F.greatest(F.size(F.split(before, "\n", -1)) - most + 1, F.lit(1)), F.lit(most)))
    last = F.transform(last, lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", ""))
    is_title = lambda x: x.rlike(SUBTITLE)
    stops = lambda x: (x.startswith("#") | x.startswith("*")) & (F.contains(x, F.lit("Art.")) | F.contains(x, F.lit("**")))
    found = F.get(F.filter(last, lambda x: is_title(x) | stops(x)), F.lit(0))
    return F.when(is_title(found), F.regexp_replace(found, r"(?U)\A\*+\s*", ""))


def articles(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, chunk_id, article_number, part, hierarchy columns, hierarchy, content: the first text of each article of each part (preamble, annex).

    A level holds the last heading before the article, whatever higher headings came in between.
    """
    order = Window.partitionBy(id).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs, id, text)
    number = F.regexp_extract("line", ARTICLE, 1)
    found = lambda p: F.when(F.regexp_extract("line", p, 1) != "", F.trim(F.regexp_extract("line", p, 1)))
    rows = rows.withColumns({"number": number, "stops": (number != "") | F.col("line").rlike(STOP) | F.col("line").rlike(FOOTER), "annexed": F.col("line").rlike(ANNEX)})
    rows = rows.withColumns({k: F.last(found(p), True).over(so_far) for k, p in LEVELS.items()} | {"piece": F.sum(F.col("stops").cast("int")).over(so_far), "part": F.when(F.max("annexed").over(so_far), "anexo").otherwise("preambulo")})
    first = lambda c: F.min_by(c, "pos").alias(c)
    out = rows.groupBy(id, "piece").agg(*map(first, ("number", "part", *LEVELS)), F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).where("number <> ''")
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy(id, "part", "number").orderBy("start"))).where("nth = 1")
    content = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"(?U)\A\s+|\s+\z", "")
    return out.select(id, F.concat_ws("_", F.col(id).cast("string"), "part", F.lit("art"), "number").alias("chunk_id"), F.col("number").alias("article_number"), "part", *LEVELS, F.concat_ws(" > ", *LEVELS).alias("hierarchy"), content.alias("content"))


def references(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in REFERENCES))))


def chunk_metadata(text: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(text, F.lit("(?m)" + p)).cast("long")
    n = {"num_paragraphs": count(r"^\s*-\s*\*\*§\s*(único|Único|\d+[º°]?)\*\*"), "num_incisos": count(r"^\s*-\s+([IVXLCDM]+)\s*[-–]"), "num_alineas": count(r"^\s*-\s+([a-z])\)")}
    return n | {"has_" + k[4:]: c > 0 for k, c in n.items()} | {"char_count": F.length(text).cast("long"), "references": references(text)}


def context(ranked: DataFrame, most: int = 8000, query: str = "query_id", text: str = "content", rank: str = "rank") -> DataFrame:
    """query, context: numbered chunks by rank up to the first that would pass the budget of characters."""
    piece = F.concat(F.lit("[Trecho "), F.col(rank).cast("string"), F.lit("]\n"), F.col(text), F.lit("\n"))
    rows = ranked.select(query, F.col(rank).alias("rank"), piece.alias("piece"))
    rows = rows.withColumn("size", F.sum(F.length("piece")).over(Window.partitionBy(query).orderBy("rank"))).where(F.col("size") <= most)
    return rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("p")).select(query, F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("context"))
