"""Suffix-array dedup: bytes of passages that an earlier document holds too.

Method. A passage is a string of length bytes; it counts in the smallest document that has it. Suffixes are dealt into
buckets by what passages that are equal have in common: the least hash of the 16-byte strings of a passage, its anchor.
Successive passages with one anchor travel as one run of text, so that a byte is shuffled a few times, not length times.
Runs are first known by anchor and hash: of runs that are equal as a whole all but those of the smallest document are
covered, and anchors of one document only, or of one kind of run, are done. The runs of all other anchors are sent to
their buckets as text, each kind by its smallest document, and sorted there as suffixes by prefix doubling up to length
bytes (suffixes.py), whole buckets of anchors at a time; suffixes that no other document can share leave between the
steps. Those that share length bytes form classes; a class's smallest document keeps its bytes.
Covered stretches go back to their documents and are united.

Anchors that a sample of documents finds in very many of them are split by document before their runs are compared, and
their runs, like those of any bucket above BUCKET bytes, are compared by digests of all their passages in a grouping
with partial sums, in which a passage that is frequent even so is spread. Which way a run goes never changes the result.

Defined cases: a null text is empty. Texts are UTF-8 bytes, passages never go over their ends, and texts shorter than
length have none. Rows with one doc_id are one document: repeats among them stay. A null doc_id counts as the largest
one. Extra columns stay, whatever their names. A long text is taken in pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import documents, free_names, looked_up, map_text, saved, slices, small

#: Bytes of a passage, of the strings whose hashes are anchors; passages of a run at most.
LENGTH, GRAM, RUN = 50, 16, 512
#: Bytes of text that a task hashes at a time, of text whose runs share a part of the shuffle, of a block of buckets that is sorted at a time.
SLICE, PART, BUCKET = 1 << 21, 24 << 20, 1 << 21
#: Least number of parts; anchors in more documents than CROWD are split by document.
PARTS, CROWD = 64, 1 << 18
#: Entries that a task packs at a time.
PACK = 1 << 19
U = np.uint64
LOW = U((1 << 48) - 1)
LAST = (1 << 63) - 1
PACKED = "part int, kind byte, blob binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place of x."""
    n = len(x) - GRAM + 1
    word = lambda at: np.ndarray((n,), U, x.data, at, (1,))
    return _mix(word(0) * U(0xC2B2AE3D27D4EB4F) ^ _mix(word(8)))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minima over windows of h."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def runs_of(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start in x, bytes, anchor, hash) of the runs of pieces of x, which have at least length bytes each."""
    h = gram_hashes(x)
    least = _least(h, length - GRAM + 1)
    n = ends - starts - length + 1
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = least[1:] != least[:-1]
    new[first] = True
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(at)])
    if size.max() > RUN:
        times = -(-size // RUN)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        begin, size = np.repeat(begin, times) + inner * RUN, np.minimum(RUN, np.repeat(size, times) - inner * RUN)
    piece = np.searchsorted(first, begin, side="right") - 1
    start, size = at[begin], size + length - 1
    digest, step = size.astype(U), 0
    on = np.arange(len(start))
    while len(on := on[size[on] > step]):
        digest[on] = _mix(digest[on] * U(0xD6E8FEB86659FD93) + h[start[on] + np.minimum(step, size[on] - GRAM)])
        step += GRAM
    return piece, start, size, least[begin] & LOW, digest


def _parts_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(key.astype(np.int64).view(U) if key.dtype != U else key) % U(parts)).astype(np.int32)


def _packed(part: np.ndarray, kind: int, columns: dict) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED: the entries of each part as a compressed table."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    table = pa.RecordBatch.from_pydict(columns).take(pa.array(order))
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    blobs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(table.slice(a, b - a))
        blobs.append(sink.getvalue().to_pybytes())
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array(np.full(len(blobs), kind, np.int8)), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


def _by_part(df: DataFrame, parts: int, f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the entries of each part of packed rows."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if part != at and held:
                    yield from f(pa.concat_tables(held))
                    held = []
                at = part
                held.append(pa.ipc.open_stream(blob).read_all())
        if held:
            yield from f(pa.concat_tables(held))

    return df.select("part", "blob").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _cols(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from those before them."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """d (doc_id, null last), row (hash of the text), text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"), *more)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a batch's texts."""
    column = batch.column("text")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of pieces of texts, together about SLICE bytes at a time; pieces of a text overlap so that each passage is in one."""
    row, start, end, size = [], [], [], 0
    for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        while b - a >= length:
            c = min(b, a + SLICE)
            row.append(i)
            start.append(a)
            end.append(c)
            size += c - a
            if size >= SLICE:
                yield np.array(row), np.array(start), np.array(end)
                row, start, end, size = [], [], [], 0
            a = c - length + 1
    if row:
        yield np.array(row), np.array(start), np.array(end)


def _anchored(texts: DataFrame, length: int, parts: int, crowd: np.ndarray, salts: int) -> DataFrame:
    """Packed runs: anchor, hash, document, place and bytes. Anchors of crowd (sorted) are dealt by document too."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def out():
            h, s, d, row, pos, size = (np.concatenate(c) for c in zip(*held, strict=True))
            key = h.copy()
            if len(crowd):
                hot = np.isin(h, crowd)
                key[hot] = _mix(h[hot] + (_mix(d[hot].view(U) ^ row[hot].view(U)) % U(salts)) * U(0x9E3779B97F4A7C15))
            columns = {"high": (h >> U(32)).astype(np.uint16), "low": h.astype(np.uint32), "s": s, "d": d, "row": row, "pos": pos.astype(np.int64), "size": size.astype(np.int32)}
            yield from _packed(_parts_of(key, parts), 0, columns)

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = _texts(batch)
                ds, rows = batch.column("d").to_numpy(), batch.column("row").to_numpy()
                for row, start, end in _pieces(offsets, length):
                    x = np.concatenate([data[a:b] for a, b in zip(start, end, strict=True)])
                    ends = np.cumsum(end - start)
                    piece, at, size, h, s = runs_of(x, ends - (end - start), ends, length)
                    who = row[piece]
                    held.append((h, s, ds[who], rows[who], at - (ends - (end - start))[piece] + start[piece] - offsets[who], size))
                    count += len(h)
                    if count >= PACK:
                        yield from out()
                        held, count = [], 0
        if held:
            yield from out()

    return texts.mapInArrow(run, PACKED)


def _settled(parts: int, crowd: np.ndarray) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Of the runs of a part: those that a smaller document has too (kind 0), those whose text is needed (kind 1), dealt by document."""

    def f(table: pa.Table) -> Iterator[pa.RecordBatch]:
        high, low, s, d, row, pos, size = _cols(table, "high", "low", "s", "d", "row", "pos", "size")
        h = (high.astype(U) << U(32)) | low.astype(U)
        order = np.lexsort((d, s, h))
        h, s, d, row, pos, size = (c[order] for c in (h, s, d, row, pos, size))
        new_h, new = _new(h), _new(h, s)
        of_h, of = np.cumsum(new_h) - 1, np.cumsum(new) - 1
        later = d > d[new][of]
        begin = np.flatnonzero(new_h)
        several = (np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)) & (np.bincount(of_h, new) > 1)
        asked = ~later & (several[of_h] | np.isin(h, crowd))
        for kind, which in ((0, later), (1, asked)):
            who = np.flatnonzero(which)
            who = who[np.lexsort((pos[who], row[who], d[who]))]
            yield from _packed(_parts_of(d[who].view(U) ^ row[who].view(U), parts), kind, {"d": d[who], "row": row[who], "pos": pos[who], "size": size[who].astype(np.int64)})

    return f


def _per_document(unite: bool) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """d, row, places: from and to of a part's entries of each document, united where they meet."""

    def f(table: pa.Table) -> Iterator[pa.RecordBatch]:
        d, row, pos, size = _cols(table, "d", "row", "pos", "size")
        order = np.lexsort((pos, row, d))
        d, row, pos = d[order], row[order], pos[order]
        end = pos + size[order]
        if unite:
            group = np.cumsum(_new(d, row))
            wide = np.int64(int(end.max()) + 2)
            top = np.maximum.accumulate(group * wide + end) - group * wide  # the farthest end so far in the document
            new = _new(d, row)
            new[1:] |= pos[1:] > top[:-1]
            begin = np.flatnonzero(new)
            d, row, pos, end = d[begin], row[begin], pos[begin], top[np.r_[begin[1:], len(top)] - 1]
        begin = np.flatnonzero(_new(d, row))
        places = np.stack([pos, end], 1).astype("<i4")  # a text has less than 2 GB
        blobs = [places[a:b].tobytes() for a, b in zip(begin, np.r_[begin[1:], len(d)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d[begin]), pa.array(row[begin]), pa.array(blobs, pa.binary())], names=["d", "row", "places"])

    return f


def _fetched(texts: DataFrame, wanted: DataFrame, parts: int, crowd: np.ndarray) -> DataFrame:
    """Packed texts of the wanted runs, dealt by anchor (kind 0), those of crowd (kind 1) anyhow."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: list[tuple] = []
        count = 0

        def out():
            h, d, row, pos, size = (np.concatenate(c) for c in list(zip(*held, strict=True))[:5])
            ends = np.cumsum(size)
            x = np.concatenate([c[5] for c in held])
            text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
            hot = np.isin(h, crowd)
            for kind in (0, 1):
                who = np.flatnonzero(hot == kind)
                key = h[who] if kind == 0 else _mix(d[who].view(U) ^ pos[who].view(U))
                yield from _packed(_parts_of(key, parts), kind, {"h": h[who], "d": d[who], "row": row[who], "pos": pos[who], "text": text.take(pa.array(who))})

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = _texts(batch)
                for i, (d, row, blob) in enumerate(zip(batch.column("d").to_pylist(), batch.column("row").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                    at = np.frombuffer(blob, "<i4").reshape(-1, 2).astype(np.int64)
                    for some in np.array_split(at, max(1, int((at[:, 1] - at[:, 0]).sum()) // SLICE)):
                        size = some[:, 1] - some[:, 0]
                        first = np.cumsum(size) - size
                        x = data[np.repeat(some[:, 0] + offsets[i] - first, size) + np.arange(size.sum())]
                        held.append((_anchor_of(x, first, size), np.full(len(size), d, np.int64), np.full(len(size), row, np.int64), some[:, 0], size, x))
                        count += len(x)
                        if count >= 4 * SLICE:
                            yield from out()
                            held, count = [], 0
        if held:
            yield from out()

    return texts.join(wanted, ["d", "row"]).select("d", "row", "places", "text").mapInArrow(run, PACKED)


def _anchor_of(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = gram_hashes(x)
    n = size - GRAM + 1
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.minimum.reduceat(h[at], np.cumsum(n) - n) & LOW


def classes(text: np.ndarray, ends: np.ndarray, d: np.ndarray, length: int) -> np.ndarray:
    """Places of passages of length bytes that a smaller document has too. ends: end of each byte's string, d: its document."""
    at, group = suffixes.repeated(text, ends, d, length)
    if not len(at):
        return at
    who, begin = d[at], np.flatnonzero(_new(group))
    return np.sort(at[who > np.minimum.reduceat(who, begin)[group]])


def _sorted_buckets(parts: int, length: int, most: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Of the texts of a part: covered stretches by document (kind 0), texts of anchors above most bytes (kind 1)."""

    def f(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.take(pa.array(np.argsort(table.column("h").to_numpy(), kind="stable"))).combine_chunks()
        h, d, row, pos = _cols(table, "h", "d", "row", "pos")
        text = table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text")
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8)
        begin = np.flatnonzero(np.r_[_new(h), True])
        k = 0
        while k < len(begin) - 1:
            last = k + 1
            while last < len(begin) - 1 and offsets[begin[last + 1]] - offsets[begin[k]] <= most:
                last += 1
            a, b = int(begin[k]), int(begin[last])
            k = last
            x, size = data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
            if len(x) > most:
                yield from _packed(_parts_of(d[a:b].view(U) ^ pos[a:b].view(U), parts), 1, {"h": h[a:b], "d": d[a:b], "row": row[a:b], "pos": pos[a:b], "text": text.slice(a, b - a)})
                continue
            ends = np.repeat(np.cumsum(size), size)
            string = np.repeat(np.arange(a, b), size)
            at = classes(x, ends, d[string], length)
            if not len(at):
                continue
            who = string[at]
            new = _new(who) | np.r_[True, at[1:] > at[:-1] + length]
            first = np.flatnonzero(new)
            stop = at[np.r_[first[1:], len(at)] - 1] + length
            who = who[first]
            place = at[first] - (offsets[who] - offsets[a]) + pos[who]
            order = np.lexsort((place, row[who], d[who]))
            who, place, size = who[order], place[order], (stop - at[first])[order]
            yield from _packed(_parts_of(d[who].view(U) ^ row[who].view(U), parts), 0, {"d": d[who], "row": row[who], "pos": place, "size": size})

    return f


def _passages(packed: DataFrame, length: int) -> DataFrame:
    """w1, w2 (digest), d, row, pos of all passages of packed texts."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                for r in pa.ipc.open_stream(blob).read_all().to_batches(4096):
                    out = []
                    for d, row, pos, text in zip(*(r.column(c).to_pylist() for c in ("d", "row", "pos", "text")), strict=True):
                        for i in range(len(text) - length + 1):
                            w = hashlib.md5(text[i : i + length]).digest()
                            out.append((int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), d, row, pos + i))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["w1", "w2", "d", "row", "pos"])

    return packed.select("blob").mapInArrow(run, "w1 long, w2 long, d long, row long, pos long")


def _crowded(texts: DataFrame, length: int, rows: int) -> np.ndarray:
    """Anchors that a sample of documents finds in more than CROWD of all, the most frequent 100,000 at most: how runs are dealt depends on them, results don't."""
    if rows <= CROWD:
        return np.zeros(0, U)
    take = min(rows, max(20_000, 16 * rows // CROWD))

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = _texts(batch)
                for row, start, end in _pieces(offsets, length):
                    x = np.concatenate([data[a:b] for a, b in zip(start, end, strict=True)])
                    ends = np.cumsum(end - start)
                    piece, _, _, h, _ = runs_of(x, ends - (end - start), ends, length)
                    both = np.unique(np.stack([h.view(np.int64), row[piece]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0])], names=["h"])

    some = texts.where(F.pmod(F.xxhash64(F.lit(11), "d", "row"), F.lit(1 << 20)) < F.lit(take * (1 << 20) // rows))
    least = max(8, CROWD * take // rows // 2)
    found = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least)
    return np.sort(np.array([r.h for r in found.orderBy(F.desc("count")).limit(100_000).collect()], np.int64).view(U))


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row (hash of the text), places: binary of little-endian ints, from and to of each maximal covered stretch in turn. Documents without one have no row. length is at least 24."""
    if length < GRAM + 8:
        raise ValueError(f"passages of {length} bytes are too short for anchors of {GRAM}")
    texts = _keyed(docs)
    rows, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    parts, salts = max(PARTS, -(-total // PART)), max(2, -(-rows // CROWD))
    crowd = _crowded(texts, length, rows)
    first = saved(_by_part(_anchored(texts, length, parts, crowd, salts), parts, _settled(parts, crowd), PACKED))
    places = "d long, row long, places binary"
    wanted = saved(_by_part(first.where("kind = 1"), parts, _per_document(False), places))
    fetched = saved(_fetched(texts, small(wanted), parts, crowd))
    sorted_ = saved(_by_part(fetched.where("kind = 0"), parts, _sorted_buckets(parts, length, BUCKET), PACKED))
    marks = first.where("kind = 0").unionByName(sorted_.where("kind = 0"))
    rest = fetched.where("kind = 1").unionByName(sorted_.where("kind = 1"))
    if not rest.isEmpty():
        passages = saved(_passages(rest, length))
        least = saved(passages.groupBy("w1", "w2").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("weight")))
        late = looked_up(passages, least, ["w1", "w2"], "weight", F.xxhash64("d", "row", "pos")).where("d > least").select("d", "row", "pos")

        def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            d, row, pos = (batch.column(c).to_numpy() for c in ("d", "row", "pos"))
            yield from _packed(_parts_of(d.view(U) ^ row.view(U), parts), 0, {"d": d, "row": row, "pos": pos, "size": np.full(len(d), length, np.int64)})

        marks = marks.unionByName(late.mapInArrow(lambda batches: (x for b in batches for x in pack(b)), PACKED))
    out = saved(_by_part(marks, parts, _per_document(True), places))
    return out.select(F.when(F.col("d") < LAST, F.col("d")).alias("doc_id"), "row", "places")


def _stretches(places: bytes | None) -> np.ndarray:
    return np.frombuffer(places or b"", "<i4").reshape(-1, 2).astype(np.int64)


def _rest(text: bytes, places: bytes | None) -> bytes:
    at, out = 0, []
    for a, b in _stretches(places).tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def with_places(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """docs with their covered stretches (null: none)."""
    doc, row = free_names(docs, "_id", "_row")
    right = found.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("places").alias(name))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(small(right), docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(row)), "left").drop(doc, row)


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, their text without covered stretches; where a cut leaves part of a character, that goes too. A text that loses nothing stays as it is, null too."""
    (name,) = free_names(docs, "_places")

    @F.pandas_udf("string")
    def cut(text, places):
        return text.combine(places, lambda t, p: t if p is None else _rest(t.encode(), p).decode("utf-8", "ignore"))

    out = with_places(docs, found, name)
    text: Column = F.when(F.col(name).isNull(), F.col("text")).otherwise(cut(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(name)))
    return out.withColumn("text", text).select(*docs.columns)


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = with_places(docs, covered(docs), "places")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), "places")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, places in zip(batch.column("text"), batch.column("places").to_pylist(), strict=True):
            text, at = text.as_buffer(), _stretches(places)
            sha, end = hashlib.sha256(), 0
            for a, b in at.tolist():
                sha.update(text[end:a])
                end = b
            sha.update(text[end:])
            out.append((text.size, int((at[:, 1] - at[:, 0]).sum()), len(at), sha.hexdigest()))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_text(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
