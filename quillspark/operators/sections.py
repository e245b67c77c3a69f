"""Sections of documents: outlines of bounded length, chunks that carry the titles above them, Markdown.

Sections are rows (id, position, title, level, content) as pages.pages_to_sections gives them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from .chunking import split_at

CHUNKS = "array<struct<content: string, section_title: string, section_level: int, has_context: boolean, part_number: int>>"


def depth(sections: DataFrame, id: str = "doc_id", most: int = 100) -> DataFrame:
    """id, depth: the deepest level down to which a document has at most that many titles (its highest level at least)."""
    n = sections.where("level > 0 and coalesce(trim(title), '') <> ''").groupBy(id, "level").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("so_far", F.sum("n").over(Window.partitionBy(id).orderBy("level")))
    return n.groupBy(id).agg(F.coalesce(F.max(F.when(F.col("so_far") <= most, F.col("level"))), F.min("level")).alias("depth"))


def outline(sections: DataFrame, id: str = "doc_id", most: int = 100) -> DataFrame:
    """id, position, entry: a line with as many # as the title's level, down to the document's depth; anchors go."""
    rows = sections.where("level > 0 and coalesce(trim(title), '') <> ''").join(depth(sections, id, most), id).where("level <= depth")
    title = F.trim(F.regexp_replace("title", r"\s*\{#[^}]+\}", ""))
    return rows.select(id, "position", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), title).alias("entry"))


def markdown(sections: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, markdown: headings by level and contents in order."""
    head = F.when((F.col("level") > 0) & (F.col("title") != ""), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title")))
    piece = F.concat_ws("\n\n", head, F.nullif(F.col("content"), F.lit("")))
    rows = sections.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("position", piece.alias("piece")))).alias("s"))
    return rows.select(id, F.array_join(F.filter(F.transform("s", lambda s: s["piece"]), lambda p: p != ""), "\n\n").alias("markdown"))


# Titles that begin a law's structure, first lines that name it, marks of paragraphs, clauses and letters.
ANNEX, TOP, SUBSECTION = r"(?iU)^(?:ANEXO|REGULAMENTO)", r"(?iU)^(?:LIVRO|TÍTULO|CAPÍTULO)", r"(?iU)^Subse[çc][ãa]o"
ENACTED = r"(?iU)^(?:DECRETO|LEI|INSTRUÇÃO NORMATIVA|PORTARIA|RESOLUÇÃO)"
PARAGRAPH = r"(?isU)^(?:\*\*)?\s*((?:§|Parágrafo)\s*(?:único|\d+[º°]?)\.?)\s*(.*?)(?:\*\*)?$"
CLAUSE, LETTER = r"(?sU)^-?\s*([IVX]+)\s*[-–—]\s*(.*)", r"(?sU)^-?\s*([a-z])\)\s*(.*)"
BODY = "## 📖 Texto Normativo"


def _depth(level: Column, annex: Column, article: Column, start: Column, position: Column) -> Column:
    """A title's level among 1 to 10 (0: body): two below its own from the law's first book, title, chapter or annex on; articles are items."""
    began = F.coalesce(start <= position, F.lit(False))
    within = F.when(level.isin(1, 2, 4, 5), level + 2).when(level == 3, F.when(article, 7).otherwise(5)).when(level == 6, F.when(article, 7).otherwise(0)).otherwise(level)
    return F.when(annex, 2).when(began, within).when(article & ((level != 0) | start.isNotNull()), 7).otherwise(level)


def _spaces(n: Column) -> Column:
    return F.repeat(F.lit(" "), n.cast("int"))


def _heading(title: Column, depth: Column) -> Column:
    bold = F.concat(F.lit("**"), title, F.lit("**"))
    item = F.concat(F.lit("  * "), F.when(title.rlike(SUBSECTION), bold).otherwise(title))
    nested = F.concat(_spaces(F.when(depth == 8, 2).when(depth == 9, 4).otherwise((depth - 8) * 2)), F.lit("- "), bold)
    return F.when(depth == 0, bold).when(depth <= 6, F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), title)).when(depth == 7, item).otherwise(nested)


def _item(line: Column, pattern: str, depth: Column, article: Column, bold: bool, after: str = "") -> Column:
    """A paragraph, clause or letter as a heading down to level 6, below that as an item of a list, deeper within an article."""
    mark, body = F.concat(F.regexp_extract(line, pattern, 1), F.lit(after)), F.regexp_replace(F.regexp_extract(line, pattern, 2), r"(?U)^\s+|\s+$", "")
    join = lambda m: F.when(body == "", m).otherwise(F.concat(m, F.lit(" "), body)) if bold else F.concat(m, F.lit(" "), body)
    text = join(F.concat(F.lit("**"), mark, F.lit("**")) if bold else mark)
    indent = F.when(depth == 7, 0).when(depth == 8, 2).when(depth == 9, 2 if bold else 4).otherwise((depth - 8) * 2)
    listed = F.concat(_spaces(indent + F.when(article, 2).otherwise(0)), F.when(depth == 7, "* ").otherwise("- "), text)
    return F.concat(F.lit("\n"), F.when(depth <= 6, F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), join(mark))).otherwise(listed), F.lit("\n"))


def _nested(content: Column, depth: Column, article: Column) -> Column:
    below = lambda n: F.when(depth > 0, depth + n).otherwise(6 + n)

    def line(raw: Column) -> Column:
        x = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
        return (
            F.when(x == "", "").when(x.rlike(PARAGRAPH), _item(x, PARAGRAPH, below(1), article, True)).when(x.rlike(CLAUSE), _item(x, CLAUSE, below(2), article, False, " -"))
            .when(x.rlike(LETTER), _item(x, LETTER, below(3), article, False, ")")).otherwise(raw)
        )

    return F.concat(F.array_join(F.transform(F.split(content, "\n", -1), line), "\n"), F.lit("\n"))


def nested_markdown(sections: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, markdown: a law's sections with titles on levels 1 to 10, and paragraphs, clauses and letters nested below them (B2).

    The title is the first line of a first section without level that names a law, else the id. Null levels are 0, null
    titles and contents empty. One shuffle by id: the window and the aggregate share it.
    """
    own = Window.partitionBy(id)
    rows = sections.select(id, "position", F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content")))
    rows = rows.withColumns({"annex": F.col("title").rlike(ANNEX), "article": legal.is_article_start(F.col("title"))})
    begins = F.col("annex") | (F.col("level") == 1) | ((F.col("level") > 1) & F.col("title").rlike(TOP))
    rows = rows.withColumn("start", F.min(F.when(begins, F.col("position"))).over(own))
    rows = rows.withColumn("depth", _depth(*(F.col(c) for c in ("level", "annex", "article", "start", "position"))))
    head = F.when(F.col("title") != "", F.concat(F.lit("\n"), _heading(F.col("title"), F.col("depth")), F.lit("\n")))
    body = F.when(F.col("content") != "", _nested(F.col("content"), F.col("depth"), F.col("article")))
    name = F.regexp_replace(F.split("content", "\n", 2)[0], r"(?U)^\s+|\s+$", "")
    rows = rows.select(id, F.struct("position", F.when((F.col("level") == 0) & name.rlike(ENACTED), name).alias("name"), F.concat_ws("\n", head, body).alias("piece")).alias("s"))
    rows = rows.groupBy(id).agg(F.array_sort(F.collect_list("s")).alias("s"))
    title = F.concat(F.lit("# "), F.coalesce(F.col("s")[0]["name"], F.col(id).cast("string")), F.lit("\n"))
    return rows.select(id, F.concat_ws("\n", title, F.lit(f"{BODY}\n"), F.array_join(F.filter(F.transform("s", lambda s: s["piece"]), lambda p: p != ""), "\n")).alias("markdown"))


class Cutter:
    """Chunks of one document's sections, a section at a time in order. The context holds the titles above a section, of levels 1
    to 3; legacy drops the last of them also below a section that isn't among these levels itself. A long section is cut
    between paragraphs; a paragraph that is longer stays whole. Parts join paragraphs by two blanks and the last one stands
    behind a blank line. What is kept between sections is the titles above."""

    def __init__(self, max_size: int = 1000, with_context: bool = True, legacy: bool = False):
        self.max_size, self.with_context, self.legacy = max_size, with_context, legacy
        self.above: list[tuple[int, str]] = []

    def add(self, title: str | None, level: int | None, content: str | None) -> Iterator[dict]:
        title, level, content, above = title or "", int(level or 0), content or "", self.above
        while above and above[-1][0] >= level:
            above.pop()
        own = level <= 3
        names = [t for _, t in (above[:-1] if self.legacy and not own else above)]
        if own:
            above.append((level, title))
        context = " > ".join(names) + "\n\n" if self.with_context and names else ""
        made = lambda body, part=None: {"content": body.strip(), "section_title": title, "section_level": level, "has_context": bool(context), "part_number": part}
        if len(content) + len(context) <= self.max_size:
            yield made(context + content)
            return
        held, size, part = [], len(context), 0
        for p in filter(None, map(str.strip, split_at(content, "\n\n"))):
            if size + len(p) + 2 > self.max_size:
                if held:
                    part += 1
                    yield made(context + "  ".join(held), part)
                held, size = [p], len(context) + len(p)
            else:
                held.append(p)
                size += len(p) + 2
        if held:
            yield made(f"{context}\n\n{'  '.join(held)}", part + 1)


def chunk(titles: list, levels: list, contents: list, max_size: int = 1000, with_context: bool = True, legacy: bool = False) -> list[dict]:
    """Chunks of one document's sections."""
    cutter = Cutter(max_size, with_context, legacy)
    return [c for x in zip(titles, levels, contents) for c in cutter.add(*x)]


def chunk_sections(sections: DataFrame, id: str = "doc_id", max_size: int = 1000, with_context: bool = True, legacy: bool = False) -> DataFrame:
    """id, chunk_id (<id>_chunk_<n>), n and the fields of a chunk, a document at a time in Arrow batches."""

    @F.pandas_udf(CHUNKS)
    def cut(titles: pd.Series, levels: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([chunk(t, v, c, max_size, with_context, legacy) for t, v, c in zip(titles, levels, contents)])

    rows = sections.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("position", "title", F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), "content"))).alias("s"))
    field = lambda name: F.transform("s", lambda s: s[name])
    rows = rows.select(id, F.posexplode(cut(field("title"), field("level"), field("content"))).alias("n", "c"))
    return rows.select(id, F.concat(F.col(id).cast("string"), F.lit("_chunk_"), F.col("n").cast("string")).alias("chunk_id"), "n", "c.*")


def bar(value: Column, most: Column, width: int) -> Column:
    """A bar of text, filled in proportion (halves to the even number); empty where most is 0."""
    filled = F.coalesce(F.bround(F.try_divide(value.cast("double"), most.cast("double")) * width).cast("int"), F.lit(0))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
