"""Spelling variants: words one edit apart, by bands of letter-parity masks.

Method. A word's mask has a bit for each letter (the accented ones share bits), set where the letter occurs an odd number of
times. One inserted or deleted letter flips one bit, a replaced one flips two at most, so that of three bands of the mask
one stays equal. Letters are dealt over the bands by how common they are, so that no band is weak. Words meet by band,
value of the band and length; a group holds the words of a length and those that are one longer. Verification begins with
halves: an edit leaves the first or the last half of a word as it is, so that only words of a group that share one are
looked at; their masks are compared by bit counts, and what is left is compared letter by letter. A pair counts in its
first equal band and half only. Nothing but sums and the best neighbour of each word leaves a task. A group of more than
BLOCK words is dealt by the halves themselves into parts, in which each of its words stands twice, so that a common band
value does not fill a task.

The form of a word is its most frequent near word where that is frequent enough, the root the last of a chain of forms.
Chains are short, since the counts along a chain grow at least by the factor; they are followed by doubling.

Defined cases: a null text has no words; a null doc_id is written as an empty string. Rows that repeat count each. Extra
columns are ignored. Words may have any length. An empty table gives an empty result. Frequencies that tie go to the
smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_text, saved, small

#: Letters from common to rare; their bits are dealt over the bands in turn.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
BANDS, BITS = 3, 20
MIN_CHARS, MIN_COUNT, FACTOR = 7, 2, 10
#: Distinct words that a task holds while it counts, words of an undivided group, words whose groups are compared at a time.
HELD, BLOCK, CHUNK = 1 << 18, 1 << 13, 1 << 16
#: Groups up to this size are compared in step, larger ones each for itself.
STEP = 48


def letter_bits() -> np.ndarray:
    """The bit of each of the 256 first code points: band i has the bits from i * BITS on."""
    bits = np.zeros(256, np.uint64)
    rest = [c for c in range(256) if chr(c) not in COMMON]
    for k, c in enumerate([*map(ord, COMMON), *rest]):
        bits[c] = np.uint64(1) << np.uint64(k % BANDS * BITS + k // BANDS % BITS)
    return bits


def masks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Parity masks of words, none empty, that lie one after the other in data."""
    return np.bitwise_xor.reduceat(letter_bits()[data], starts) if len(starts) else np.zeros(0, np.uint64)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, noise: int = 31) -> DataFrame:
    """word, n: maximal runs of Latin letters, A-Z lower-cased, of at least min_chars. Where noise divides the checksum of `doc_id:run`, the letter at checksum modulo length is left out."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_chars},}}")

    def run(batches):
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            n = pa.array(np.fromiter(held.values(), np.int64, len(held)))
            held.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found, n in Counter(runs.findall(text)).items():
                    word = found.encode("latin-1").lower()  # bytes: A-Z only
                    h = zlib.crc32(word if found.isascii() else word.decode("latin-1").encode(), base)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of words in Latin-1."""
    data = [w.encode("latin-1") for w in words.to_pylist()]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum(lengths) - lengths, lengths


def _key(band: int, value: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each group; groups that share one by chance do no harm, since all is verified."""
    x = (value * np.uint64(BANDS) + np.uint64(band)) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def banded(words: DataFrame, min_chars: int) -> DataFrame:
    """key, band, longer (is the word one longer than its group), word, n: a word stands in two groups of each band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts, lengths = _flat(batch.column("word"))
        mask = masks(data, starts, lengths)
        rows, keys, bands, longer = [], [], [], []
        for band in range(BANDS):
            value = (mask >> np.uint64(band * BITS)) & np.uint64((1 << BITS) - 1)
            for more in (0, 1):
                at = np.flatnonzero(lengths > min_chars) if more else np.arange(len(lengths))
                rows.append(at)
                keys.append(_key(band, value[at], lengths[at] - more))
                bands.append(np.full(len(at), band, np.int8))
                longer.append(np.full(len(at), more, np.int8))
        at = pa.array(np.concatenate(rows))
        columns = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(bands)), pa.array(np.concatenate(longer)), batch.column("word").take(at), batch.column("n").take(at)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "band", "longer", "word", "n"])

    return map_text(words.select("word", "n"), run, "key long, band byte, longer byte, word string, n long", limit=1 << 20, column="word")


def divided(rows: DataFrame, most: int) -> DataFrame:
    """Rows of banded with side and part. Groups of up to most words: 0 and 0. Words of larger groups stand once by their first half (side 1) and once by their last half (side 2), dealt into parts by that half."""
    large = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most))
    if large.isEmpty():
        return rows.select("*", F.lit(0).alias("side"), F.lit(0).cast("long").alias("part"))
    rows = rows.join(small(large), "key", "left").withColumn("half", F.floor((F.length("word") - F.col("longer")) / 2).cast("int"))
    rows = rows.withColumn("side", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
    last = F.length("word") - F.col("longer") - F.col("half")
    half = F.when(F.col("side") == 1, F.substring("word", F.lit(1), F.col("half"))).otherwise(F.right("word", last))
    part = F.when(F.col("side") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(half), F.ceil(F.col("size") / most)))
    return rows.select("key", "band", "longer", "word", "n", "side", part.cast("long").alias("part"))


#: Powers of an odd number modulo 2**64 and of its inverse, as far as they were needed.
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> list[np.ndarray]:
    if len(POWERS[0]) < n:
        for k, x in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            POWERS[k] = np.multiply.accumulate(steps)
    return POWERS


def _halves(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last half of each word, both as long as those of the group's shorter words."""
    up, down = _powers(len(data) + 1)
    table = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    size = lengths - longer
    of = lambda a, b: (sums[b] - sums[a]) * down[a]
    ends = starts + lengths
    return of(starts, starts + size // 2), of(ends - (size - size // 2), ends)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Numbers of runs of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _meetings(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows that share a group (numbered in turn), some at a time."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    at = np.flatnonzero(np.repeat(sizes <= STEP, sizes))
    left = np.repeat(starts + sizes, sizes)[at] - at - 1  # rows of the group behind a row
    step = 1
    while len(at := at[left >= step]):
        left = left[left >= step]
        yield at, at + step
        step += 1
    for s, n in zip(starts[sizes > STEP], sizes[sizes > STEP], strict=True):
        wide = max(1, (1 << 20) // n)
        for r in range(0, n, wide):
            a, b = np.meshgrid(np.arange(r, min(n, r + wide)), np.arange(r, n), indexing="ij")
            ok = a < b
            yield a[ok] + s, b[ok] + s


def _candidates(group: np.ndarray, side: np.ndarray, band: np.ndarray, longer: np.ndarray, mask: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group that share a half, whose masks fit, and that this band and half have to find."""
    low = np.uint64((1 << BITS) - 1)
    first, last = halves
    for k, half in ((1, first), (2, last)):
        rows = np.flatnonzero(side != 3 - k)
        rows = rows[np.lexsort((half[rows], group[rows]))]
        for a, b in _meetings(_runs(group[rows], half[rows])):
            a, b = rows[a], rows[b]
            x = mask[a] ^ mask[b]
            ok = (np.bitwise_count(x) <= 2) & (longer[a] + longer[b] < 2)
            if k == 2:
                ok &= first[a] != first[b]
            a, b, x = a[ok], b[ok], x[ok]
            own = np.full(len(a), BANDS - 1, np.int8)
            for i in range(BANDS - 2, -1, -1):
                own[(x >> np.uint64(i * BITS)) & low == 0] = i
            ok = own == band[a]
            yield a[ok], b[ok]


def _near(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs differ by exactly one inserted, deleted or replaced letter."""
    flip = lengths[a] > lengths[b]
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    out, gap = np.zeros(len(a), bool), lengths[b] - lengths[a]
    for n in np.unique(lengths[a]).tolist():
        for more in (0, 1):
            at = np.flatnonzero((lengths[a] == n) & (gap == more))
            for part in np.array_split(at, max(1, len(at) * n >> 21)):
                if not len(part):
                    continue
                x = data[starts[a[part], None] + np.arange(n)]
                y = data[starts[b[part], None] + np.arange(n + more)]
                same = x == y[:, :n]
                if more:
                    head = np.where(same.all(1), n, same.argmin(1))
                    tail = (x == y[:, 1:])[:, ::-1]
                    out[part] = head + np.where(tail.all(1), n, tail.argmin(1)) >= n
                else:
                    out[part] = same.sum(1) == n - 1
    return out


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best: the number of words one edit away and the most frequent of them, of words (saved; word, n) that have any."""

    def summed(table: pa.Table) -> pa.RecordBatch:
        col = lambda c: table.column(c).to_numpy()
        text = table.column("word").combine_chunks()
        data, starts, lengths = _flat(text)
        longer = col("longer").astype(np.int64)
        group = _runs(col("key"), col("side"), col("part"))
        found = []
        for a, b in _candidates(group, col("side"), col("band"), longer, masks(data, starts, lengths), _halves(data, starts, lengths, longer)):
            ok = np.abs(lengths[a] - lengths[b]) <= 1
            a, b = a[ok], b[ok]
            ok = _near(data, starts, lengths, a, b)
            found.append((a[ok], b[ok]))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        a, b = np.r_[a, b], np.r_[b, a]
        number, names = pd.factorize(text.to_numpy(zero_copy_only=False))  # rows of one word
        order = np.argsort(names.astype(object))
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        n = col("n")
        a, other = number[a], b
        best = np.lexsort((place[number[other]], -n[other], a))
        a, other = a[best], other[best]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(a)])
        columns = [pa.array(names[a[first]], pa.string()), pa.array(counts), pa.array(n[other[first]]), pa.array(names[number[other[first]]], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                held.append(batch)
                rows += batch.num_rows
                if rows < CHUNK:
                    continue
                table = pa.Table.from_batches(held)
                group = _runs(*(table.column(c).to_numpy() for c in ("key", "side", "part")))
                if cut := int(np.searchsorted(group, group[-1])):  # the last group may go on
                    yield summed(table.slice(0, cut))
                    held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if rows:
            yield summed(pa.Table.from_batches(held))

    parts = max(64, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = divided(banded(words, min_chars), block).repartition(parts, "key", "side", "part").sortWithinPartitions("key", "side", "part")
    rows = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a saved table of word, form (not null): forms are followed to the last, twice as far in each round."""
    out = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(out.join(small(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return out
        out = step.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; distinct, of at least min_chars letters)."""
    words = saved(words.select("word", "n"))
    near = saved(words.join(near_words(words, min_chars, block), "word", "left"))
    fits = F.col("best_n") >= factor * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    found = saved(roots(saved(near.where("form is not null").select("word", "form"))))
    return near.join(small(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(documents(spark, sf_dir)).where(F.col("n") >= MIN_COUNT))
