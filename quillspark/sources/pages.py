"""HTML pages to sections and plain text: headings and paragraphs in document order, tables as pipe tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TEXT = 3
_HEADS = {f"h{i}": i for i in range(1, 7)}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.open: list[list] = []
        self.skip = 0
        self.title = ""
        self.titles = 0
        self.in_title = False
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.titles += 1
            self.in_title = True
        elif tag == "meta":
            a = dict(attrs)
            if (k := a.get("name") or a.get("property")) and a.get("content"):
                self.meta[k] = a["content"]
        elif tag in _HEADS or tag == "p":
            if tag == "p":
                self._close("p")
            self.open.append([tag, []])
        elif tag == "br":
            self.handle_data(" ")

    def _close(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, parts = self.open.pop()
                self.out.append((t, "".join(parts)))
                if t == tag:
                    break

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in _HEADS or tag == "p":
            self._close(tag)

    def handle_data(self, data):
        if self.in_title:
            if self.titles == 1:  # a page is named by its first title; others are of pictures, or of pages within it
                self.title += data
        elif not self.skip:
            for _, parts in self.open:
                parts.append(data)


def read_page(html: str) -> dict:
    r = _Reader()
    r.feed(html or "")
    r.close()
    while r.open:
        t, parts = r.open.pop()
        r.out.append((t, "".join(parts)))
    sections: list[dict] = []
    for tag, text in r.out:
        text = re.sub(r"\s+", " ", text).strip()
        if tag in _HEADS:
            sections.append({"title": text, "content": [], "level": _HEADS[tag], "tag_name": tag})
        elif len(text) >= MIN_TEXT:
            if not sections:
                sections.append({"title": "", "content": [], "level": 0, "tag_name": None})
            sections[-1]["content"].append(text)
    for s in sections:
        s["content"] = "\n".join(s["content"])
    title = re.sub(r"\s+", " ", r.title).strip() or next((s["title"] for s in sections if s["level"] == 1), "")
    return {"title": title, "metadata": r.meta, "sections": sections}


def table_to_markdown(rows: list[list[str]]) -> str:
    """Two rows and columns at least; short rows are padded, bars in cells escaped."""
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or width < 2:
        return ""
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def pages_to_sections(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, page_title, position, title, content, level, tag_name."""

    @F.pandas_udf("struct<title: string, metadata: map<string, string>, sections: array<struct<title: string, content: string, level: int, tag_name: string>>>")
    def read(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(t) for t in x], columns=["title", "metadata", "sections"])

    # Marked so that the filter which explode implies doesn't read each page a second time.
    rows = pages.select(id, read.asNondeterministic()(F.col(html)).alias("p"))
    return rows.select(id, F.col("p.title").alias("page_title"), F.posexplode("p.sections").alias("position", "s")).select(id, "page_title", "position", "s.*")
