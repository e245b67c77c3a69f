"""Pages of any layout to sections, their titles and metadata, records of conversions, and reports as files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import laws, pages

_CLASSES = "|".join([*laws.HEADING_CLASSES, *laws.ARTICLE_CLASSES, *laws.QUOTE_CLASSES, *laws.PLAIN_CLASSES])
ROOT = r"(?i)<app-root[\s>]"
STYLED = rf"""(?is)<p\b[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?(?:{_CLASSES})(?:\s[^"]*)?"|'(?:[^']*\s)?(?:{_CLASSES})(?:\s[^']*)?'|(?:{_CLASSES})[\s>])"""
KINDS = {".html": "page", ".htm": "page", ".pdf": "pages", ".docx": "office", ".doc": "office", ".odt": "office", ".epub": "office", ".rtf": "office", ".txt": "text", ".md": "text"}


def extractor(extension: Column) -> Column:
    """Which reader a file's extension asks for: page, pages (PDF), office, text; null for others."""
    low = F.lower(extension)
    return F.coalesce(*(F.when(low.isin(*[e for e, k in KINDS.items() if k == kind]), kind) for kind in dict.fromkeys(KINDS.values())))


def layout(html: Column) -> Column:
    """segmented (an application root), styled (a paragraph of a known class) or generic."""
    return F.when(html.rlike(ROOT), "segmented").when(html.rlike(STYLED), "styled").otherwise("generic")


def sections(found: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, position, title, level, content of pages by their layout; headings of styled pages take the titles behind them."""
    rows = found.select(id, F.col(html).alias("html"), layout(F.col(html)).alias("layout"))
    part = lambda kind: rows.where(F.col("layout") == kind).select(id, "html")
    columns = [id, "position", "title", "level", "content"]
    out = laws.merged(laws.styled_sections(part("styled"), id), id).select(*columns)
    out = out.unionByName(laws.segmented_sections(part("segmented"), id).select(*columns))
    return out.unionByName(pages.pages_to_sections(part("generic"), id).select(*columns))


def page_info(found: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, title (the page's, else its first heading's), metadata (names and properties of meta tags), layout, n_sections."""

    @F.pandas_udf("struct<title: string, metadata: map<string, string>, n: int>")
    def read(x: pd.Series) -> pd.DataFrame:
        rows = [pages.read_page(t) for t in x]
        return pd.DataFrame({"title": [r["title"] for r in rows], "metadata": [r["metadata"] for r in rows], "n": [len(r["sections"]) for r in rows]})

    rows = found.select(id, layout(F.col(html)).alias("layout"), read(F.col(html)).alias("p"))
    return rows.select(id, F.col("p.title").alias("title"), F.col("p.metadata").alias("metadata"), "layout", F.col("p.n").alias("n_sections"))


def conversion_counts(converted: DataFrame, error: str = "error") -> DataFrame:
    """total, success, failure of files that were converted one by one."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col(error).isNotNull())
    return converted.agg(n.alias("total"), (n - bad).alias("success"), bad.alias("failure"))


def conversion_record(files: DataFrame, markdown: str = "markdown", source_type: str = "legislation") -> DataFrame:
    """A record of each conversion by its whole path: source_file, source_hash, source_type, file_type, file_size_bytes, markdown_size_bytes. files: path, content and the Markdown."""
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("source_hash"), F.lit(source_type).alias("source_type"), kind.alias("file_type"), F.octet_length("content").cast("long").alias("file_size_bytes"), F.octet_length(markdown).cast("long").alias("markdown_size_bytes"))


def comparison_strings(report: DataFrame, decimals: int = 2) -> DataFrame:
    """Doubles as strings of fixed decimals."""
    return report.select(*(F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in report.dtypes))


def flat(experiments: DataFrame, config: str = "config", metrics: str = "aggregated_metrics") -> DataFrame:
    """A row for each experiment with its plain columns, config_<name> and a column for each metric; names are those that any experiment has."""
    names = lambda c: [r[0] for r in experiments.select(F.explode(F.map_keys(c))).distinct().orderBy(F.col("col")).collect()]
    plain = [c for c in experiments.columns if c not in (config, metrics) and not dict(experiments.dtypes)[c].startswith(("array", "map", "struct"))]
    return experiments.select(*plain, *(F.col(config)[k].alias(f"config_{k}") for k in names(config)), *(F.col(metrics)[k].alias(k) for k in names(metrics)))


def write_flat(rows: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, semicolons and decimal commas."""
    shown = rows.select(*(F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in rows.dtypes))
    first = shown.columns[0]
    shown.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def write_report(report: DataFrame, path: str, title: str = "") -> None:
    """A small report as JSON, CSV and lines of text, in folders below path."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    report.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    line = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in report.columns))
    report.select(F.concat(F.lit(f"{title}\n" if title else ""), line, F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/txt")
