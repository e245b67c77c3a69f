"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method. Documents are tokenised once, into pieces of at most `capacity` ids of which only length and checksum are kept.
Packing needs lengths only: on the driver, over the histogram of at most `capacity` lengths, pieces above a third of
the capacity are matched greedily, at most two in a sequence, and smaller ones go, longest first, to the smallest gap
that holds them. The outcome is a list of patterns with their numbers of sequences; each piece finds its place by its
rank among the pieces of its length. Ranks come from counts of hash parts, so that no length gathers in one task.

Defined cases: a null text is empty; an empty text is the end id alone. Rows that share a doc_id are packed each.
The first piece of a long document is the shorter one; very long texts are tokenised whole. Strings of added tokens in a
text get the ids of those tokens, as the tokenizer's own settings have it. A null doc_id stays null. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_text, ranked, saved

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k"


def encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """texts -> lists of ids, as tokenizers' encode(add_special_tokens=False) gives them for vocabulary.json.

    vocabulary.tiktoken has the same vocabulary as ranks and yields the same ids in a quarter of the time (tested over all
    code points and random texts); texts that hold an added token's string or that it rejects, and all texts if there is
    no such file, go to tokenizers.
    """
    import base64
    import json
    import os
    import re

    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path(vocabulary + ".json"))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made: dict = {}

    def slow(texts):
        if "slow" not in made:
            from tokenizers import Tokenizer

            made["slow"] = Tokenizer.from_file(f"{folder}/{vocabulary}.json")
        return [x.ids for x in made["slow"].encode_batch(texts, add_special_tokens=False)]

    if not os.path.exists(ranks := f"{folder}/{vocabulary}.tiktoken"):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})

    with open(f"{folder}/{vocabulary}.json", encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f)["added_tokens"]]
    special = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def encode(texts):
        out = []
        for t in texts:
            try:
                out.append(slow([t])[0] if special.search(t) else fast.encode_ordinary(t))
            except BaseException as e:  # its regex engine gives up on some texts, by a Rust panic
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
                out.append(slow([t])[0])
        return out

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((i, capacity) for i in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id, row (hash of the text), piece, start, length, ids_crc32."""
    made: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "encode" not in made:
            made["encode"] = encoder(vocabulary, folder)
        at, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(made["encode"](batch.column("text").to_pylist())):
            data = np.append(np.asarray(ids, np.dtype("<u4")), np.uint32(end)).astype("<u4").tobytes()
            for k, (a, n) in enumerate(cut(len(data) // 4, capacity)):
                at.append(i)
                piece.append(k)
                start.append(a)
                length.append(n)
                crc.append(zlib.crc32(data[4 * a : 4 * (a + n)]))
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_text(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text")), run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long", limit=1 << 20)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, repeats), ...]) by large-item matching and best fit."""
    left = dict(histogram)
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    put = lambda n, items: by_gap.setdefault(capacity - sum(a * b for a, b in items), []).append((n, items)) if n else None
    large = sorted((x for x in left if x > capacity // 3), reverse=True)
    for x in large:
        for y in (y for y in large if y <= x and x + y <= capacity):
            if not left[x]:
                break
            n = left[x] // 2 if x == y else min(left[x], left[y])
            put(n, [(x, 1), (y, 1)] if x != y else [(x, 2)])
            left[x] -= n
            left[y] -= n
        put(left[x], [(x, 1)])
        left[x] = 0
    for x in sorted((x for x in left if x <= capacity // 3), reverse=True):
        n = left[x]
        while n:
            gap = min((g for g in by_gap if g >= x and by_gap[g]), default=None)
            if gap is None:
                many, items, gap = n, [], capacity
            else:
                many, items = by_gap[gap].pop()
            each = min(gap // x, n)
            bins = min(many, n // each)
            put(bins, [*items, (x, each)])
            if items and many > bins:
                by_gap[gap].append((many - bins, items))
            n -= bins * each
        left[x] = 0
    return [x for g in sorted(by_gap) for x in by_gap[g]]


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a saved table of pieces."""
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used: dict[int, int] = {}
    slots, base = [], 0
    for n, parts in patterns(histogram, capacity):
        offset = 0
        for length, each in parts:
            slots.append((length, used.get(length, 0), each, base, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        base += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    def run(batches):
        for x in batches:
            length, rank = (x.column(c).to_numpy() for c in ("length", "rank"))
            s = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if len(table) else np.empty((0, 5), np.int64)
            k = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([x.column(c) for c in names] + [pa.array(s[:, 3] + k // s[:, 2]), pa.array(s[:, 4] + k % s[:, 2] * length)], names=[*names, "sequence_id", "offset"])

    names = items.columns
    rows = ranked(items, ["length"], [F.col("doc_id"), F.col("row"), F.col("piece")], "rank", F.xxhash64("doc_id", "row", "piece"))
    kinds = ", ".join(f"{c} {t}" for c, t in items.dtypes)
    return rows.select(*names, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(saved(pieces(documents(spark, sf_dir))))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
