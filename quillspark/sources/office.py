"""PDF and office files: bytes to pages or Markdown by a pluggable reader on the executors, pages to sections as windows.

Readers are not part of this package. A PDF reader takes bytes and gives the pages' texts; the default one needs pypdf.
The converter of office files runs pandoc, if it is installed, over standard input. A file that can't be read keeps its
row with the error; the others go on.
"""

from __future__ import annotations

import io
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.structure import line_class

MIN_SECTION, TIMEOUT = 50, 300
LEVELS = {"chapter": 1, "section": 2, "title": 2, "article": 3, "paragraph": 4}
FORMATS = {".docx": "docx", ".odt": "odt", ".html": "html", ".htm": "html", ".epub": "epub", ".rtf": "rtf"}


def pypdf_pages(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF reader: install pypdf or pass read=") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def pandoc_markdown(data: bytes, extension: str, timeout: int = TIMEOUT) -> str:
    if extension not in FORMATS:
        raise ValueError(f"unsupported format {extension!r}")
    done = subprocess.run(["pandoc", "-f", FORMATS[extension], "-t", "markdown", "--wrap=none"], input=data, capture_output=True, timeout=timeout, check=True)
    return done.stdout.decode()


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of the files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def pdf_pages(found: DataFrame, read: Callable[[bytes], list[str]] = pypdf_pages) -> DataFrame:
    """path, page_number (from 1; null for a file that failed), text, error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    pages, error = read(bytes(data)), None
                except Exception as e:  # noqa: BLE001 - whatever a reader raises
                    pages, error = [None], f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": path, "page_number": pd.array([None] if error else range(1, len(pages) + 1), "Int32"), "text": pages, "error": error})

    return found.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string")


def markdown_of(found: DataFrame, convert: Callable[[bytes, str], str] = pandoc_markdown) -> DataFrame:
    """path, content_sha256, markdown, error: one record for each whole path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    rows.append((convert(bytes(data), "." + path.rsplit(".", 1)[-1].lower()), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"path": frame["path"], "content_sha256": frame["content_sha256"], "markdown": [m for m, _ in rows], "error": [e for _, e in rows]})

    return found.select("path", F.sha2("content", 256).alias("content_sha256"), "content").mapInPandas(run, "path string, content_sha256 string, markdown string, error string")


def page_sections(pages: DataFrame, id: str = "path", page: str = "page_number", text: str = "text", least: int = MIN_SECTION) -> DataFrame:
    """id, position, title, level, type, page_number, content: the lines behind each heading down to the next, over pages.

    Lines before the first heading and sections under the least length are left out; a document of which nothing stays is one
    section with its whole text. Null pages are empty.
    """
    pages = pages.select(id, F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = pages.select(id, "page", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    rows = rows.withColumn("type", line_class(F.col("line")))
    rows = rows.withColumn("nth", F.sum(F.col("type").isNotNull().cast("int")).over(Window.partitionBy(id).orderBy("page", "at").rowsBetween(Window.unboundedPreceding, 0)))
    head = lambda c: F.max(F.when(F.col("type").isNotNull(), F.col(c))).alias(c)
    out = rows.where("nth > 0").groupBy(id, "nth").agg(head("line"), head("page"), F.max("type").alias("type"), F.array_sort(F.collect_list(F.when(F.col("type").isNull(), F.struct("page", "at", "line")))).alias("l"))
    level = F.coalesce(*(F.when(F.col("type") == t, n) for t, n in LEVELS.items()))
    out = out.select(id, F.col("nth").cast("int").alias("position"), F.col("line").alias("title"), level.alias("level"), "type", F.col("page").alias("page_number"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
    out = out.where(F.length("content") >= least)
    whole = pages.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p")).join(out.select(id).distinct(), id, "left_anti")
    whole = whole.select(id, F.lit(1).alias("position"), F.lit("Documento Completo").alias("title"), F.lit(1).alias("level"), F.lit("full_document").alias("type"), F.lit(1).alias("page_number"), strip(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("content"))
    return out.unionByName(whole)
