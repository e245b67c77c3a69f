"""Secret scans: a trigram inverted index picks the documents in which a rule's regular expression can match.

Method. From each rule's expression a Boolean query over trigrams is derived (what every match must contain, by cases).
Texts are indexed in segments of some megabytes: the positions of the trigrams that any query names give a sorted
posting list for each. A query intersects and unites posting lists; the rule's expression runs over the documents that
remain, whole. A rule without mandatory trigrams runs over all documents of the segment. A segment is what one task
holds at a time, so the index needs no shuffle and grows with nothing.

Defined cases: a null text is empty and has no spans. Spans are code points, end exclusive, leftmost and not
overlapping within a kind; kinds may overlap each other. Rows that share a doc_id are scanned each; a null doc_id stays
null. Extra columns are ignored. An empty table gives an empty result. Very long texts are read whole, each rule in one
pass over a run of characters.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_text


@dataclass(frozen=True)
class Rule:
    """pattern's matches whose group has least characters or more; same: an equivalent of both that runs faster."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII
    same: str | None = None


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, same=r"[0-9a-f]{32,}"),
)
#: These begin where a run begins and never give back what they took, so that a long run is read once.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"bearer\x20++[A-Za-z0-9._~+/-]{20,}+", 0, 0, re.ASCII | re.IGNORECASE),
    Rule("url", r"(?<![a-z])[a-z]++://[^\s/:@]++:[^\s/@]{3,}+@"),
)

ANY = ("any",)
#: A class of more characters than CHARS counts as any; of more strings than STRINGS only their ends are kept.
CHARS, STRINGS = 12, 64


def _all(*parts):
    parts = {p for q in parts for p in (q[1] if q[0] == "and" else [q]) if p != ANY}
    return ANY if not parts else next(iter(parts)) if len(parts) == 1 else ("and", tuple(sorted(parts, key=repr)))


def _one(*parts):
    return ANY if ANY in parts else next(iter({*parts})) if len({*parts}) == 1 else ("or", tuple(sorted({*parts}, key=repr)))


def _within(strings) -> tuple:
    """The query for containing one of the strings."""
    return _one(*(_all(*(("has", s[i : i + 3]) for i in range(len(s) - 2))) for s in strings)) if strings else ANY


@dataclass(frozen=True)
class _Part:
    """What matches are (exact) or begin and end with, and a query that holds for whatever contains one."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: tuple = ANY

    def bounded(self) -> _Part:
        exact, query = self.exact, self.query
        first, last = exact or self.first, exact or self.last
        if exact is not None and len(exact) > STRINGS:
            query, exact = _all(query, _within(exact)), None
        if len(first) > STRINGS:
            first = frozenset({""})
        if len(last) > STRINGS:
            last = frozenset({""})
        return _Part(exact, first, last, query)

    def whole(self) -> tuple:
        return _all(self.query, _within(self.exact) if self.exact is not None else ANY)


_EMPTY = frozenset({""})
_NONE = _Part(_EMPTY, _EMPTY, _EMPTY)
_WILD = _Part(None, _EMPTY, _EMPTY)


def _then(a: _Part, b: _Part) -> _Part:
    cross = lambda x, y: frozenset(s + t for s in x for t in y)
    if a.exact is not None and b.exact is not None:
        e = cross(a.exact, b.exact)
        return _Part(e, e, e, _all(a.query, b.query)).bounded()
    first = cross(a.exact, b.first) if a.exact is not None else a.first
    last = cross(a.last, b.exact) if b.exact is not None else b.last
    query = _all(a.query, b.query, _within(cross(a.exact if a.exact is not None else a.last, b.exact if b.exact is not None else b.first)))
    return _Part(None, first, last, _all(query, _within(first), _within(last))).bounded()


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None and p.query == ANY for p in parts):
        e = frozenset().union(*(p.exact for p in parts))
        return _Part(e, e, e).bounded()
    union = lambda which: frozenset().union(*(p.exact if p.exact is not None else which(p) for p in parts))
    return _Part(None, union(lambda p: p.first), union(lambda p: p.last), _one(*(p.whole() for p in parts))).bounded()


def _char(codes: list[int], flags: int) -> _Part:
    if len(codes) > CHARS:
        return _WILD
    if flags & re.IGNORECASE and not flags & re.ASCII and any(c > 127 or chr(c) in "iIkKsS" for c in codes):
        return _WILD
    e = frozenset(chr(c).encode().lower().decode() for c in codes)
    return _Part(e, e, e)


def _derive(tree, flags: int) -> _Part:
    out = _NONE
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = _char([arg], flags)
        elif name == "IN":
            codes: list[int] | None = []
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    codes.append(x)
                elif str(kind) == "RANGE" and x[1] - x[0] <= CHARS:
                    codes += range(x[0], x[1] + 1)
                else:
                    codes = None
                    break
            part = _WILD if codes is None else _char(codes, flags)
        elif name == "SUBPATTERN":
            part = _derive(arg[3], (flags | arg[1]) & ~arg[2])
        elif name == "BRANCH":
            part = _either([_derive(x, flags) for x in arg[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            inner = _derive(inner, flags)
            if low == 0:
                part = _either([inner, _NONE]) if high == 1 else _WILD
            else:
                part = inner
                for _ in range(min(low, 3) - 1):
                    part = _then(part, inner)
                if high != low or low > 3:
                    part = _Part(None, part.exact or part.first, part.exact or part.last, part.whole())
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = _NONE
        elif name == "ATOMIC_GROUP":
            part = _derive(arg, flags)
        else:
            part = _WILD
        out = _then(out, part)
    return out


def trigram_query(pattern: str, flags: int = re.ASCII) -> tuple:
    """("any",), ("has", trigram), ("and", queries) or ("or", queries): holds for each text, A-Z in lower case, that the pattern matches in."""
    tree = sre.parse(pattern, flags)
    return _derive(tree, flags | tree.state.flags).whole()


def _trigrams(query: tuple) -> set[bytes]:
    """Three bytes of each trigram; of one with other characters than ASCII, its first three bytes."""
    return {query[1].encode()[:3]} if query[0] == "has" else set() if query == ANY else set().union(*map(_trigrams, query[1]))


class Segment:
    """Posting lists of the wanted trigrams over some texts."""

    def __init__(self, texts: list[bytes], number: np.ndarray, wanted: list[bytes]):
        self.n = len(texts)
        buf = np.frombuffer(b"\xff\xff".join(texts).lower(), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])[:-1]
        self.lists: dict[bytes, np.ndarray] = {}
        if len(buf) < 3:
            return
        code = buf[:-2].astype(np.int32) << 16
        code |= buf[1:-1].astype(np.int32) << 8
        code |= buf[2:]
        found = number[code]
        at = np.flatnonzero(found)
        both = np.unique((found[at].astype(np.int64) << 40) | (np.searchsorted(starts, at, side="right") - 1))
        which, doc = both >> 40, both & ((1 << 40) - 1)
        for i, a, b in zip(*np.unique(which, return_index=True), np.append(np.unique(which, return_index=True)[1][1:], len(which)), strict=True):
            self.lists[wanted[i - 1]] = doc[a:b]

    def matching(self, query: tuple) -> np.ndarray:
        if query == ANY:
            return np.arange(self.n)
        if query[0] == "has":
            return self.lists.get(query[1].encode()[:3], np.empty(0, np.int64))
        lists = [self.matching(q) for q in query[1]]
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) by start, then in the order of the rules."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(_trigrams, queries)))
    made: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            number = np.zeros(1 << 24, np.uint16)
            for i, w in enumerate(wanted):
                number[int.from_bytes(w, "big")] = i + 1
            made.update(number=number, rules=[re.compile(r.same or r.pattern, r.flags) for r in rules])
        texts = [t or "" for t in batch.column("text").to_pylist()]
        segment = Segment([t.encode() for t in texts], made["number"], wanted)
        spans: list[list] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            for i in segment.matching(query):
                spans[i] += [(m.start(), k, m.end()) for m in made["rules"][k].finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return map_text(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *map(count, [r.kind for r in BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
