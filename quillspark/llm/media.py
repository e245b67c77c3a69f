"""Media columns: texts as FLAC streams, their PCM blocks with seekable sample offsets, and features.

Method. A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, become 8-bit mono samples (byte minus
128) of a FLAC stream in blocks of 576 with a seek point each. Reading back decodes Rice residuals and predictors of
many frames in step, verifies both checksums of every frame and the stream's MD5, and yields PCM blocks with their sample
offsets; digests and features are folded over the blocks in turn. Encoding, decoding and folding hold a bounded number of
frames beside the text and its stream, however long the text is.

Defined cases: a null or empty text is one block of bytes 255. A null media value or one that is no valid stream
raises ValueError in decoding; pcm_blocks(..., broken="null") returns a row with a null block for it instead. A null key
stays null; rows that share a key follow each other. Extra columns are ignored unless named. An empty table gives an empty
result. Blocks of streams of several channels hold their samples interleaved; offsets count samples of a channel.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import documents, map_text, slices


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (-len(data) % flac.BLOCK or (0 if data else flac.BLOCK))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, payloads = zip(*map(padded, batch.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(flac.encode(list(payloads)), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_text(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, media binary", limit=1 << 20)


def pcm_blocks(media: DataFrame, key: str = "doc_id", broken: str = "fail", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, columns to carry, block, sample_offset, pcm (samples as little-endian signed integers of whole bytes): a row for each block of flac.BLOCK samples, a stream's blocks in turn."""
    columns = [key, *carry]
    kinds = ", ".join(f"`{c}` {t}" for c, t in media.select(*columns).dtypes)

    def rows_of(batch: pa.RecordBatch, streams: list[tuple[int, bytes]]):
        """Batches of the blocks of streams (row, media)."""
        heads = [flac.header(m) for _, m in streams]
        rest: dict[int, np.ndarray] = {}
        for i, offset, x in flac.segments([m for _, m in streams]):
            width, channels = (heads[i]["bits"] + 7) // 8, heads[i]["channels"]
            size = flac.BLOCK * channels
            held = rest.pop(i, np.empty(0, np.int32))
            offset -= len(held) // channels
            x = np.concatenate([held, x]) if len(held) else x
            whole = len(x) if offset + len(x) // channels >= heads[i]["samples"] > 0 else len(x) // size * size
            if whole < len(x):
                rest[i] = x[whole:]
            data = x[:whole].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].reshape(-1)
            ends = np.append(np.arange(0, whole, size), whole) * width if whole else np.zeros(1, np.int64)
            n = len(ends) - 1
            pcm = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            first = offset // flac.BLOCK
            own = [batch.column(c).take(pa.array(np.full(n, streams[i][0], np.int64))) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(first, first + n), pa.int32()), pa.array(np.arange(n) * flac.BLOCK + offset, pa.int64()), pcm], names=[*columns, "block", "sample_offset", "pcm"])
        for i, x in rest.items():  # streams that don't say how many samples they have
            width, channels = (heads[i]["bits"] + 7) // 8, heads[i]["channels"]
            data = x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
            raise ValueError(f"a stream ends within a block, after {len(data) // width // channels} samples of it")

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for batch in slices(whole, "media", 1 << 20):
                streams = list(enumerate(batch.column("media").to_pylist()))
                if broken != "null":
                    if any(m is None for _, m in streams):
                        raise ValueError("no media")
                    yield from rows_of(batch, streams)
                    continue
                for i, m in streams:
                    try:
                        if m is None:
                            raise ValueError("no media")
                        found = list(rows_of(batch, [(i, m)]))
                    except (ValueError, IndexError, KeyError):
                        own = [batch.column(c).slice(i, 1) for c in columns]
                        found = [pa.RecordBatch.from_arrays([*own, pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([None], pa.binary())], names=[*columns, "block", "sample_offset", "pcm"])]
                    yield from found

    return media.select(*columns, "media").mapInArrow(run, f"{kinds}, block int, sample_offset long, pcm binary")


class Fold:
    """Digests and features of the blocks of a text's stream, added in turn."""

    def __init__(self):
        self.n, self.sha, self.tail, self.last = 0, hashlib.sha256(), b"", None
        self.sum = self.energy = self.crossings = 0
        self.low, self.high = 1 << 30, -(1 << 30)

    def add(self, x: np.ndarray) -> None:
        """x: 8-bit samples."""
        payload = (x.view(np.uint8) ^ 0x80).tobytes()
        self.n += len(payload)
        self.sha.update(payload)
        self.tail = (self.tail + payload)[-32:] if len(payload) < 32 else payload[-32:]
        wide = x.astype(np.int64)
        self.sum += int(wide.sum())
        self.energy += int((wide * wide).sum())
        below = wide < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.last is not None and self.last != bool(below[0]))
        self.last = bool(below[-1])
        self.low, self.high = min(self.low, int(wide.min())), max(self.high, int(wide.max()))

    def features(self) -> str:
        """Sum, energy, zero crossings and extremes of the samples, as whole numbers."""
        return f"sum={self.sum};energy={self.energy};crossings={self.crossings};low={self.low};high={self.high}"


def folded(blocks: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """carried columns, payload_bytes, payload_sha256, tail_crc32, feature of streams from their PCM blocks, which stand in turn in a partition."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in blocks.select(*carry).dtypes)
    schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])

    def run(batches):
        held: tuple[pa.RecordBatch, Fold] | None = None

        def flushed(done: list[tuple[pa.RecordBatch, Fold]]) -> pa.RecordBatch:
            own = pa.Table.from_batches([r for r, _ in done]).combine_chunks()
            made = [(f.n, f.sha.hexdigest(), zlib.crc32(f.tail), f.features()) for _, f in done]
            return pa.RecordBatch.from_arrays([*(own.column(c).combine_chunks() for c in carry), *(pa.array([m[i] for m in made], t) for i, t in enumerate(schema.types))], names=[*carry, *schema.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            pcm = batch.column("pcm")
            ends = np.frombuffer(pcm.buffers()[1], np.int32)[pcm.offset : pcm.offset + len(pcm) + 1]
            data = np.frombuffer(pcm.buffers()[2], np.int8)
            begins = np.flatnonzero(block == 0)
            done = []
            for a, b in zip([0, *begins.tolist()], [*begins.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                if block[a] == 0:
                    if held:
                        done.append(held)
                    held = (batch.slice(a, 1).select(list(carry)), Fold())
                held[1].add(data[ends[a] : ends[b]])
            if done:
                yield flushed(done)
        if held:
            yield flushed([held])

    return blocks.select(*carry, "block", "pcm").mapInArrow(run, f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op2_flac_media(spark, sf_dir: str) -> DataFrame:
    media = text_media(documents(spark, sf_dir)).withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    carry = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    out = folded(pcm_blocks(media, carry=carry[1:]), carry)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
