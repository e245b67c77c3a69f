"""Lines of legal texts: headings and their level, starts of articles, Markdown form (E3 to E6, A9's segments)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Headings by level, articles, paragraphs and list items of a law.
HEADINGS = {
    1: r"(?iU)^LIVRO\s+[IVXLCDM]+\b",
    2: r"(?iU)^TÍTULO\s+[IVXLCDM]+\b",
    3: r"(?iU)^CAPÍTULO\s+[IVXLCDM0-9]+[-\w]*\b",
    4: r"(?iU)^SEÇÃO\s+[IVXLCDM0-9]+[-\w]*\b",
    5: r"(?iU)^SUBSEÇÃO\s+[IVXLCDM0-9]+[-\w]*\b",
    6: r"(?U)^Art\.\s*\d+",
}
PARAGRAPH = r"(?U)^§\s*(?:único|Único|\d)"
CLAUSE, LETTER, NUMBER = r"(?U)^[IVX]+\s*[-–—]", r"(?U)^[a-z]\)", r"(?U)^\d+\.\s"
ARTICLE = r"(?iU)^\s*Art\.?\s*\d+(?:\.\d{3})*(?:-[A-Z]+)?[º°]?"
HEAD = r"(?sU)^(Art\.?\s*\d+(?:\.\d{3})*[º°]?(?:-[A-Z]+)?\.?)\s*(.*)"
SEGMENTS = {3: r"(?iU)^\s*CAP[IÍ]TULO\s+[IVX0-9]", 4: r"(?iU)^\s*SE[ÇC][ÃA]O\s+[IVX0-9]", 5: r"(?iU)^\s*SUBSE[ÇC][ÃA]O", 6: r"(?iU)^\s*Art\.?\s*\d+"}


def _first(x: Column, rules: dict[int, str]) -> Column:
    out = F.lit(None).cast("int")
    for level, pattern in reversed(rules.items()):
        out = F.when(x.rlike(pattern), level).otherwise(out)
    return out


def heading_level(line: Column) -> Column:
    """1 (book) to 6 (article), null for other lines; articles only as they are written, the others in either case."""
    return _first(strip(line), HEADINGS)


def segment_level(text: Column) -> Column:
    """3 to 6 for segments of a page that begin a chapter, section, subsection or article."""
    return _first(text, SEGMENTS)


def to_markdown_line(line: Column) -> Column:
    """The line's Markdown: headings and bold paragraphs between blank lines, articles with an anchor, list items."""
    x, level = strip(line), heading_level(line)
    number = F.lower(F.regexp_replace(F.regexp_extract(x, r"(\d+[º°]?(?:-[A-Z])?)", 1), "[º°]", ""))
    apart = lambda *c: F.concat(F.lit("\n"), *c, F.lit("\n"))
    return (
        F.when(level == 6, apart(F.lit("###### "), x, F.lit(" {#art-"), number, F.lit("}")))
        .when(level.isNotNull(), apart(F.repeat(F.lit("#"), level), F.lit(" "), x))
        .when(x.rlike(PARAGRAPH), apart(F.lit("**"), x, F.lit("**")))
        .when(x.rlike(CLAUSE), F.concat(F.lit("- "), x))
        .when(x.rlike(LETTER) | x.rlike(NUMBER), F.concat(F.lit("  - "), x))
        .otherwise(x)
    )


def is_article_start(text: Column) -> Column:
    """An article, not a reference to one: nothing, a capital or plain text follows its number, but no comma and no list of articles."""
    rest = strip(F.regexp_replace(text, ARTICLE + r"\.?", ""))
    refers = rest.startswith(",") | rest.rlike(r"(?iU)^[^.]*\bart\.\s*\d+")
    return F.coalesce(text.rlike(ARTICLE) & ((rest == "") | rest.rlike(r"^\p{Lu}") | ~refers), F.lit(False))


def article_head(text: Column) -> tuple[Column, Column]:
    """The article's number and what follows it; (text, '') for other texts."""
    has = text.rlike(HEAD)
    return F.when(has, strip(F.regexp_extract(text, HEAD, 1))).otherwise(text), F.when(has, strip(F.regexp_extract(text, HEAD, 2))).otherwise(F.lit(""))


def format_line(text: Column) -> Column:
    x = strip(text)
    return (
        F.when(x.rlike(r"(?iU)^§\s*(?:único|\d)"), F.concat(F.lit("\n**"), x, F.lit("**\n")))
        .when(x.rlike(CLAUSE), F.concat(F.lit("- "), x)).when(x.rlike(r"(?U)^[a-z]\)\s"), F.concat(F.lit("  - "), x)).otherwise(x)
    )
