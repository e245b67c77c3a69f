"""Cutting texts into chunks. The packings keep state along a text, so they run a text at a time in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SIZE, MIN_SIZE, OVERLAP = 1000, 100, 200
MARKER = re.compile(r"CAPÍTULO [IVXLCDM]+|SEÇÃO [IVXLCDM]+|Art\.\s*\d+|§\s*\d+|[IVXLCDM]+ -", re.IGNORECASE)
CONTEXT = re.compile(r"(?:CAPÍTULO|SEÇÃO|Art\.)\s+\S+(?:\s+\S+)?", re.IGNORECASE)
CHUNK = "array<struct<content: string, chunk_index: int, chunk_method: string, section: string, has_context: boolean>>"


def chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", source, index.cast("string")).cast("binary")), 1, 16)


def split_at(text: str, pattern: str) -> Iterator[str]:
    """The parts of re.split, one at a time."""
    at = 0
    for m in re.finditer(pattern, text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def sentence_chunks(text: str, max_size: int = MAX_SIZE, min_size: int = MIN_SIZE, with_context: bool = True) -> Iterator[dict]:
    """Sentences up to max_size; a structural marker starts a chunk of its own once min_size is reached and lends it its name. Chunks come as they are full."""

    def packed() -> Iterator[list]:
        held: list[str] = []
        size, context = 0, None

        def closed() -> list:
            body = " ".join(held)
            return [f"[{context}]\n\n{body}" if with_context and context else body, bool(context)]

        for s in (p.strip() + "." for p in split_at(text, r"\.\s+") if p.strip()):
            marker = MARKER.match(s)
            if size > 0 and (size + len(s) > max_size or (marker and size > min_size)):
                yield closed()
                held, size = [s], len(s)
                if marker and any(w in s.upper() for w in ("CAPÍTULO", "SEÇÃO", "ART.")):
                    found = CONTEXT.match(s)
                    context = found[0].strip() if found else None
            else:
                held.append(s)
                size += len(s) + 1
        if held:
            yield closed()

    for i, (content, flag) in enumerate(small_merged(packed(), max_size, min_size)):
        yield {"content": content, "chunk_index": i, "chunk_method": "legal_structural_v2", "section": None, "has_context": flag}


def pack_sentences(text: str, max_size: int = MAX_SIZE, min_size: int = MIN_SIZE, with_context: bool = True) -> list[dict]:
    return list(sentence_chunks(text, max_size, min_size, with_context))


def small_merged(chunks: Iterable[list], max_size: int = MAX_SIZE, min_size: int = MIN_SIZE) -> Iterator[list]:
    """A chunk under min_size joins the next, the last one the one before, if both stay within one and a half max_size; what is joined isn't looked at again. Two chunks are held."""
    before: list | None = None
    waiting: list | None = None
    for chunk in chunks:
        if waiting is not None and len(waiting[0]) < min_size and len(waiting[0]) + len(chunk[0]) <= 1.5 * max_size:
            waiting, chunk = None, [f"{waiting[0]} {chunk[0]}", waiting[1] or chunk[1]]
            if before:
                yield before
            before = chunk
            continue
        if waiting is not None:
            if before:
                yield before
            before = waiting
        waiting = chunk
    if waiting is not None and before and len(waiting[0]) < min_size and len(before[0]) + len(waiting[0]) <= 1.5 * max_size:
        yield [f"{before[0]} {waiting[0]}", before[1] or waiting[1]]
        return
    yield from (c for c in (before, waiting) if c)


def merge_small(chunks: list[list], max_size: int = MAX_SIZE, min_size: int = MIN_SIZE) -> list[list]:
    return list(small_merged(chunks, max_size, min_size))


def markdown_section_stream(text: str, min_size: int = MIN_SIZE) -> Iterator[tuple[str, str]]:
    """(title, content) from each heading of level two or more on; what stands before is the introduction; short ones are left out. A section is held at a time."""
    title, held, any_ = "Introdução", [], False
    for line in split_at(text, "\n"):
        m = re.match(r"##+\s+(.+)", line)
        if m:
            content = "\n".join(held).strip()
            if len(content) >= min_size:
                any_ = True
                yield title, content
            title, held = m[1].strip(), []
        held.append(line)
    content = "\n".join(held).strip()
    if len(content) >= min_size:
        yield title, content
    elif not any_:
        yield "Documento Completo", text


def markdown_sections(text: str, min_size: int = MIN_SIZE) -> list[tuple[str, str]]:
    return list(markdown_section_stream(text, min_size))


def paragraph_chunks(text: str, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> Iterator[tuple[str, str]]:
    """(content, method) of a section over max_size: paragraphs, those over max_size by sentences; short tails are carried over."""
    held: list[str] = []
    size = 0
    for p in (x.strip() for x in split_at(text, "\n\n")):
        if not p:
            continue
        if len(p) > max_size:
            if held:
                yield "\n\n".join(held), "markdown_split_paragraph"
                held, size = [], 0
            part: list[str] = []
            n = 0
            for s in split_at(p, r"(?<=[.!?])\s+"):
                if n + len(s) > max_size and part:
                    yield " ".join(part), "markdown_split_sentence_split"
                    tail = part[-2:]
                    part = tail if overlap and len(part) > 1 and len(" ".join(tail)) <= overlap else []
                    n = sum(map(len, part))
                part.append(s)
                n += len(s)
            if part:
                yield " ".join(part), "markdown_split_sentence_split"
        elif size + len(p) > max_size and held:
            yield "\n\n".join(held), "markdown_split_paragraph"
            held = [held[-1]] if overlap and len(held[-1]) <= overlap else []
            held.append(p)
            size = sum(map(len, held))
        else:
            held.append(p)
            size += len(p)
    if held:
        yield "\n\n".join(held), "markdown_split_final"


def pack_paragraphs(text: str, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    return list(paragraph_chunks(text, max_size, overlap))


def markdown_chunks(text: str, max_size: int = MAX_SIZE, min_size: int = MIN_SIZE, overlap: int = OVERLAP) -> Iterator[dict]:
    n = 0
    for title, content in markdown_section_stream(text, min_size):
        for body, method in [(content, "markdown_section")] if len(content) <= max_size else paragraph_chunks(content, max_size, overlap):
            yield {"content": body, "chunk_index": n, "chunk_method": method, "section": title, "has_context": False}
            n += 1


def chunk_markdown(text: str, max_size: int = MAX_SIZE, min_size: int = MIN_SIZE, overlap: int = OVERLAP) -> list[dict]:
    return list(markdown_chunks(text, max_size, min_size, overlap))


def chunked(docs: DataFrame, text: str = "text", method: str = "sentences", **options) -> DataFrame:
    """docs with a row for each chunk: content, chunk_index, chunk_method, section, has_context."""
    cut = {"sentences": pack_sentences, "markdown": chunk_markdown}[method]

    @F.pandas_udf(CHUNK)
    def chunks(x: pd.Series) -> pd.Series:
        return x.map(lambda t: cut(t, **options) if t else [])

    return docs.withColumn("_c", F.explode(chunks(F.col(text)))).select(*(c for c in docs.columns if c != text), "_c.*")


def context_stack(levels: list[int], titles: list[str]) -> list[str]:
    """For each section the titles above it: a section closes those of its level or deeper, levels up to three stay open."""
    stack: list[tuple[int, str]] = []
    out = []
    for level, title in zip(levels, titles, strict=True):
        while stack and stack[-1][0] >= level:
            stack.pop()
        if level <= 3:
            stack.append((level, title))
        out.append(" > ".join(t for _, t in stack[:-1]))
    return out
