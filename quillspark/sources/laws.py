"""Pages of two official layouts to sections (A8, A9): elements by one parser pass, then levels and sections as Spark expressions.

Layout styled: paragraphs whose style classes tell headings, articles and quotations. Layout segmented: an application root
with a title block, a summary block and segments. Sections are rows (id, position, title, level, content); what stands
before the first heading is a section without title of level 0. Null or empty pages have no sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from .pages import MIN_TEXT, table_to_markdown
from .tables import slices

# Style classes with the level of their headings and articles; classes of quotations and of plain text.
HEADING_CLASSES = {"livro": 1, "titulo": 2, "subtitulo": 2, "parte": 2, "capitulo": 3, "cap": 3, "secao": 4, "subsecao": 5, "tpicodeseo": 5}
ARTICLE_CLASSES = ("04partenormativa", "16partenormativa", "artigo", "artart", "06alterao")
QUOTE_CLASSES = ("06citaopn", "citacaopn")
PLAIN_CLASSES = ("msonormal", "texto1", "texto2")
# Titles that stand whatever their class, and beginnings that make a heading of unstyled text.
ALONE = {1: r"(?iU)^LIVRO\s+[IVXLCDM]+$", 2: r"(?iU)^(ANEXO|REGULAMENTO\s+(DO\s+|DA\s+)?IMPOSTO.*|TÍTULO\s+[IVXLCDM]+(-[A-Z]+)?)$"}
BEGINS = {1: r"(?iU)^LIVRO\s", 2: r"(?iU)^T[ÍI]TULO\s", 3: r"(?iU)^CAP[IÍ]TULO\s", 4: r"(?iU)^SE[ÇC][ÃA]O\s", 5: r"(?iU)^SUBSE[ÇC][ÃA]O\s"}
ITEM = r"(?iU)^(?:(?:§|Parágrafo)\s*(?:único|\d)|[IVX]+\s*[-–]|[a-z]\))"
BODY_WORDS = ("§", "art.", "lei nº", "decreto", "inciso", "alínea")

#: Bytes of pages whose elements are held at a time.
SLICE = 1 << 20
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ROLES = {"epigrafe-ato": "title", "caixinha-ementa": "summary", "area-ementa-ato": "summary", "segmento": "segment", "conteudo-segmento-ato": "inner"}


class _Elements(HTMLParser):
    """Paragraphs, headings and outermost tables in order, and the parts of a segmented page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.table: list[list[list[str]]] | None = None
        self.tables = self.skip = 0

    def _begin(self, kind: str, tag: str, classes: list[str]) -> dict:
        self.out.append(e := {"kind": kind, "tag": tag, "classes": classes, "parts": []})
        return e

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
            return
        if tag in _VOID:
            self.handle_data(" ")
            return
        classes = (dict(attrs).get("class") or "").lower().split()
        held = None
        if tag == "table":
            self.tables += 1
            if self.tables == 1:
                held = self._begin("table", tag, classes)
                self.table = []
        elif self.table is not None:
            if tag == "tr" and self.tables == 1:
                self.table.append([])
            elif tag in ("td", "th") and self.tables == 1:
                self.table = self.table or [[]]
                self.table[-1].append([])
        elif tag == "app-root":
            self._begin("root", tag, classes)
        elif tag in _BLOCKS:
            if self.open and any(t in _BLOCKS for t, _ in self.open):
                self._end(next(t for t, _ in reversed(self.open) if t in _BLOCKS))
            held = self._begin("block", tag, classes)
        elif role := next((_ROLES[c] for c in classes if c in _ROLES), None):
            held = self._begin(role, tag, classes)
        self.open.append((tag, held))

    def _end(self, tag):
        while self.open:
            t, held = self.open.pop()
            if t == "table":
                self.tables -= 1
                if held is not None:
                    held["rows"] = [[re.sub(r"\s+", " ", "".join(c)).strip() for c in r] for r in self.table or []]
                    self.table = None
            if t == tag:
                break

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif any(t == tag for t, _ in self.open):
            self._end(tag)

    def handle_data(self, data):
        if self.skip:
            return
        if self.table is not None:
            if self.table and self.table[-1]:
                self.table[-1][-1].append(data)
            return
        for _, held in self.open:
            if held is not None:
                held["parts"].append(data)


def read_elements(html: str | None) -> list[dict]:
    r = _Elements()
    r.feed(html or "")
    r.close()
    while r.open:
        r._end(r.open[-1][0])
    found = []
    for e in r.out:
        text = table_to_markdown(e.get("rows", [])) if e["kind"] == "table" else re.sub(r"\s+", " ", "".join(e["parts"])).strip()
        found.append({"kind": e["kind"], "tag": e["tag"], "classes": e["classes"], "text": text})
    inner = {i - 1: e for i, e in enumerate(found) if e["kind"] == "inner" and i and found[i - 1]["kind"] == "segment"}
    for i, e in inner.items():
        found[i]["text"] = e["text"]
    return [e for e in found if e["kind"] != "inner"]


def elements(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, pos, kind, tag, classes, text."""
    rows = pages.select(F.col(id).alias("id"), F.col(html).cast("string").alias("html"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html", SLICE):
                found = [read_elements(t) for t in batch.column("html").to_pylist()]
                n = [len(f) for f in found]
                columns = {k: pa.array([e[k] for f in found for e in f], t) for k, t in (("kind", pa.string()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("text", pa.string()))}
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_pydict({"id": ids, "pos": pa.array([i for k in n for i in range(k)], pa.int32()), **columns})

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pos int, kind string, tag string, classes array<string>, text string")
    return out.withColumnRenamed("id", id)


def _by_sections(rows: DataFrame, id: str) -> DataFrame:
    """rows: id, pos, level (null: content), title, said (the line of content, may be null)."""
    rows = rows.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(id, "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), F.col("title"))).alias("title"), F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("pos", "said")))).alias("l"))
    content = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["said"]), "\n"), r"(?U)\A\s+|\s+\z", "")
    return out.select(id, F.col("section").cast("int").alias("position"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("level", F.lit(0)).alias("level"), content.alias("content"))


def _rule(x: Column, rules: dict[int, str]) -> Column:
    return F.coalesce(*(F.when(x.rlike(p), level) for level, p in rules.items()))


def styled_sections(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """Sections of styled pages. A title of its own goes before an article's start, that before style classes, these before heading tags."""
    x = F.col("text")
    rows = elements(pages, id, html).where((F.col("kind") == "block") & (F.length(x) >= MIN_TEXT) | (F.col("kind") == "table") & (x != ""))
    table, starts = F.col("kind") == "table", legal.is_article_start(x)
    among = lambda names: F.arrays_overlap("classes", F.array(*map(F.lit, names)))
    known = F.get(F.filter("classes", lambda c: c.isin(*HEADING_CLASSES, *ARTICLE_CLASSES, *QUOTE_CLASSES, *PLAIN_CLASSES)), F.lit(0))
    rows = rows.withColumn("class", known)
    heading = F.coalesce(*(F.when(F.col("class") == c, level) for c, level in HEADING_CLASSES.items()))
    tagged = F.when(F.col("class").isNull() & F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    short = (F.length(x) < 100) & x.rlike(r"^\p{Lu}") & ~F.exists(F.array(*map(F.lit, BODY_WORDS)), lambda w: F.contains(F.lower(x), w))
    plain = F.col("class").isNull() | F.col("class").isin(*PLAIN_CLASSES)
    loose = F.when(plain & ~x.rlike(ITEM), F.coalesce(_rule(x, BEGINS), F.when(short, 5)))
    level = F.when(table, F.lit(None).cast("int")).otherwise(F.coalesce(_rule(x, ALONE), F.when(starts, 3), heading, tagged, loose))
    head, rest = legal.article_head(x)
    article = starts & _rule(x, ALONE).isNull() & ~table
    said = (
        F.when(article, F.nullif(rest, F.lit(""))).when(F.col("level").isNotNull(), F.lit(None).cast("string"))
        .when(table, F.concat(F.lit("\n"), x)).when(among(QUOTE_CLASSES), F.concat(F.lit("> "), x)).otherwise(legal.format_line(x))
    )
    rows = rows.withColumn("level", level).withColumns({"title": F.when(article, head).otherwise(x), "said": said})
    return _by_sections(rows, id)


def segmented_sections(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """Sections of segmented pages; pages without an application root have none here."""
    x, kind = F.col("text"), F.col("kind")
    rows = elements(pages, id, html)
    rows = rows.withColumns({"root": F.max(kind == "root").over(Window.partitionBy(id)), "nth": F.row_number().over(Window.partitionBy(id, "kind").orderBy("pos"))})
    rows = rows.where("root").where(kind.isin("title", "summary") & (F.col("nth") == 1) & (x != "") | (kind == "segment") & (F.length(x) >= MIN_TEXT))
    level = F.when(kind == "title", 1).when(kind == "summary", 2).otherwise(legal.segment_level(x))
    said = F.when(kind == "summary", x).when(F.col("level").isNull(), legal.format_line(x))
    # The title and the summary come first wherever they stand; text behind them that has no heading is a section of its own.
    rows = rows.withColumn("pos", F.col("pos") + F.when(kind == "title", -2_000_000_000).when(kind == "summary", -1_000_000_000).otherwise(0))
    rows = rows.withColumn("level", level)
    first = (kind == "segment") & F.col("level").isNull() & (F.row_number().over(Window.partitionBy(id, kind == "segment").orderBy("pos")) == 1)
    rows = rows.withColumns({"title": F.when(kind == "summary", "Ementa").when(F.col("level").isNull(), "").otherwise(x), "said": said}).withColumn("level", F.when(first, 0).otherwise(F.col("level")))
    return _by_sections(rows, id)


# Numbered headings that take the title behind them, and how such titles begin.
_OF = re.compile(r"(DA|DO|DAS|DOS)\s")
_STRICT = re.compile(r"(LIVRO|TÍTULO)\s+[IVXLCDM]+(-[A-Z]+)?$")
_OPEN = re.compile(r"(CAPÍTULO\s+[IVXLCDM0-9]+(-[A-Z]+)?|SE[ÇC][ÃA]O\s+[IVXLCDM0-9]+(-[A-Z]+)?|SUBSE[ÇC][ÃA]O\s+(ÚNICA|[IVXLCDM0-9]+(-[A-Z]+)?))$")


def takes(title: str, next_title: str, next_empty: bool, joined: bool) -> bool:
    """Whether a heading without content takes the next one as its text; joined: it has taken one already."""
    a, b = title.upper().strip(), next_title.upper().strip()
    if not b:
        return False
    if a == "ANEXO" and "REGULAMENTO" in b:
        return True
    if not next_empty:
        return False
    return bool(_OF.match(b)) if joined or _STRICT.match(a) else bool(_OPEN.match(a)) and not b.startswith("ART.")


class Folder:
    """Headings without content take the next ones, a section at a time in order: ' - ' joins the first title taken, a line break each further one; the first level stays. One section is held."""

    def __init__(self):
        self.last: list | None = None
        self.taken = 0

    def add(self, title: str, level: int, content: str) -> Iterator[tuple[str, int, str]]:
        last = self.last
        if last and last[0] and not last[2].strip() and takes(last[0], title, not content.strip(), self.taken > 0 or " - " in last[0]):
            last[0] += ("\n" if self.taken or " - " in last[0] else " - ") + title
            last[2] = content
            self.taken += 1
            return
        yield from self.end()
        self.last, self.taken = [title, level, content], 0

    def end(self) -> Iterator[tuple[str, int, str]]:
        if self.last:
            yield tuple(self.last)
            self.last = None


def merge_headings(sections: list[tuple[str, int, str]]) -> list[tuple[str, int, str]]:
    """(title, level, content) by order, with numbered headings and their texts in one title."""
    folder = Folder()
    return [*(s for x in sections for s in folder.add(*x)), *folder.end()]


def merged(sections: DataFrame, id: str = "page_id") -> DataFrame:
    """sections with numbered headings and their texts in one title (E8), a document at a time in Arrow batches."""

    @F.pandas_udf("array<struct<title: string, level: int, content: string>>")
    def fold(titles: pd.Series, levels: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("title", "level", "content"), s)) for s in merge_headings([(t or "", int(v or 0), c or "") for t, v, c in zip(*x)])] for x in zip(titles, levels, contents)])

    rows = sections.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("position", "title", F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), "content"))).alias("s"))
    field = lambda name: F.transform("s", lambda s: s[name])
    return rows.select(id, F.posexplode(fold(field("title"), field("level"), field("content"))).alias("position", "x")).select(id, "position", "x.*")
