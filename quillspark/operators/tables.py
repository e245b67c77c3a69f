"""Table functions for SQL (M4): chunkers and the merge of headings as Python UDTFs.

chunk_sentences and chunk_markdown take a text and are called laterally, so that nothing is shuffled. chunk_sections and
merge_headings take a table of sections; what they say of it in analyze makes Spark deal the rows by document and sort
them by position, so that a document's sections stream through and are never gathered. All of them yield rows as they
go: what a worker holds is a text and a chunk, or a section and the titles above it.

Null or empty texts give no row; a null level is 0, a null title or content empty. Sections of a null document are one document.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..sources import laws
from . import chunking, sections

CHUNK = T.StructType().add("content", "string").add("chunk_index", "integer").add("chunk_method", "string").add("section", "string").add("has_context", "boolean")


def _text(arguments: tuple, names: tuple[str, ...]) -> AnalyzeResult:
    first, *rest = arguments
    if first is None or first.dataType not in (T.StringType(), T.NullType()):
        raise ValueError("the first argument is a text")
    for name, x in zip(names, rest, strict=True):
        if x is not None and not (x.isConstantExpression and isinstance(x.dataType, (T.IntegerType, T.LongType, T.BooleanType))):
            raise ValueError(f"{name} is a constant number or truth value")
    return AnalyzeResult(schema=CHUNK)


def _row(c: dict) -> tuple:
    return c["content"], c["chunk_index"], c["chunk_method"], c["section"], c["has_context"]


class ChunkSentences:
    """chunk_sentences(text, max_size => 1000, min_size => 100, with_context => true)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_size: AnalyzeArgument | None = None, min_size: AnalyzeArgument | None = None, with_context: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _text((text, max_size, min_size, with_context), ("max_size", "min_size", "with_context"))

    def eval(self, text, max_size=chunking.MAX_SIZE, min_size=chunking.MIN_SIZE, with_context=True):
        if text:
            yield from map(_row, chunking.sentence_chunks(text, max_size, min_size, with_context))


class ChunkMarkdown:
    """chunk_markdown(text, max_size => 1000, min_size => 100, overlap => 200)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_size: AnalyzeArgument | None = None, min_size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _text((text, max_size, min_size, overlap), ("max_size", "min_size", "overlap"))

    def eval(self, text, max_size=chunking.MAX_SIZE, min_size=chunking.MIN_SIZE, overlap=chunking.OVERLAP):
        if text:
            yield from map(_row, chunking.markdown_chunks(text, max_size, min_size, overlap))


def _sections(table: AnalyzeArgument, id: AnalyzeArgument, out: T.StructType) -> AnalyzeResult:
    """Rows of a document come together and in order; out follows the document's column."""
    if not table.isTable:
        raise ValueError("the first argument is a table of sections")
    if id is None or not id.isConstantExpression or id.value is None:
        raise ValueError("id is the name of the document's column")
    missing = {id.value, "position", "title", "level", "content"} - set(table.dataType.names)
    if missing:
        raise ValueError(f"the table lacks {sorted(missing)}")
    schema = T.StructType([table.dataType[id.value], *out.fields])
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(id.value)], orderBy=[OrderingColumn("position")])


class ChunkSections:
    """chunk_sections(TABLE(sections), id => 'doc_id', max_size => 1000, with_context => true, legacy => false)."""

    def __init__(self):
        self.cutter, self.n = None, 0

    @staticmethod
    def analyze(sections_: AnalyzeArgument, id: AnalyzeArgument, max_size: AnalyzeArgument | None = None, with_context: AnalyzeArgument | None = None, legacy: AnalyzeArgument | None = None) -> AnalyzeResult:
        out = T.StructType().add("chunk_id", "string").add("n", "integer").add("content", "string").add("section_title", "string").add("section_level", "integer").add("has_context", "boolean").add("part_number", "integer")
        return _sections(sections_, id, out)

    def eval(self, sections_, id, max_size=1000, with_context=True, legacy=False):
        self.cutter = self.cutter or sections.Cutter(max_size, with_context, legacy)
        doc = sections_[id]
        for c in self.cutter.add(sections_["title"], sections_["level"], sections_["content"]):
            yield doc, None if doc is None else f"{doc}_chunk_{self.n}", self.n, c["content"], c["section_title"], c["section_level"], c["has_context"], c["part_number"]
            self.n += 1


class MergeHeadings:
    """merge_headings(TABLE(sections), id => 'doc_id')."""

    def __init__(self):
        self.folder, self.n, self.doc = laws.Folder(), 0, None

    @staticmethod
    def analyze(sections_: AnalyzeArgument, id: AnalyzeArgument) -> AnalyzeResult:
        return _sections(sections_, id, T.StructType().add("position", "integer").add("title", "string").add("level", "integer").add("content", "string"))

    def _numbered(self, rows):
        for title, level, content in rows:
            yield self.doc, self.n, title, level, content
            self.n += 1

    def eval(self, sections_, id):
        self.doc = sections_[id]
        yield from self._numbered(self.folder.add(sections_["title"] or "", int(sections_["level"] or 0), sections_["content"] or ""))

    def terminate(self):
        yield from self._numbered(self.folder.end())


FUNCTIONS = {"chunk_sentences": ChunkSentences, "chunk_markdown": ChunkMarkdown, "chunk_sections": ChunkSections, "merge_headings": MergeHeadings}


def register(spark: SparkSession) -> SparkSession:
    """The session with the table functions under their names."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, udtf(f, useArrow=False))
    return spark
