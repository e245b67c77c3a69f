"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, thresholded by language.

Method. The model is one of characters: grams of ORDER of them within a language. One pass over all texts counts the
grams of trusted training texts and notes which grams occur at all. Counts, numbers of continuations, discounts and
back-off weights are aggregations and joins over that table, sharded by gram, and give each gram that occurs anywhere
its probability. Texts of a language are packed where they are read, some megabytes to a batch, compressed; a batch's
distinct grams meet the model by a join sharded by gram, in which a gram stands once for each batch however frequent it
is, and come back to their batch, where they are summed up for each document. The perplexity is exp of the mean of -log p. The
threshold is the language's quantile of perplexities of trusted texts that were not trained on, in the band of length
of the text (short texts vary more), and a margin above it.

Defined cases: a null or empty text has perplexity null and is rejected. A null language is one of its own. A language
or band of length without trusted texts takes the threshold of the next shorter band of its language, else of the next
longer one, and keeps all texts if there is none. Trusted texts are those with label 1; rows that share a doc_id share
its label and are scored each. Characters beyond the basic plane count as one character. Extra columns stay, whatever
their names. An empty table gives an empty result. A text longer than a batch is a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, documents, free_names, is_small, looked_up, map_text, saved, slices, small

ORDER, BITS = 4, 16
#: Bytes of text that a task works on at a time, and of a packed batch of one language; texts in hand to be packed have four times that.
BATCH, PACKED = 3 << 20, 6 << 20
#: Rows and bytes of the model that are broadcast to the batches' grams; beyond it, the joins shuffle.
MODEL_BOUNDS = (100_000, 4 << 20)
#: Quantile of the trusted texts' perplexities, what a text may lie above it, the share of trusted texts kept from training.
QUANTILE, MARGIN, HELD = 0.99, 1.1, 5
#: Bands of length: the number of bits of the number of characters, from and to.
BANDS = (5, 12)


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(packed grams of all texts in turn, one for each character; numbers of characters). Texts begin with padding."""
    pad = "\x02" * (ORDER - 1)
    x = np.frombuffer("".join(pad + (t or "") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.minimum(x, (1 << BITS) - 1).astype(np.uint64)
    n = np.array([len(t or "") for t in texts], np.int64)
    g = np.zeros(max(0, len(x) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        g = (g << np.uint64(BITS)) | x[i : len(x) - ORDER + 1 + i]
    starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    place = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    return g[place].view(np.int64), n


def by_language(batch: pa.RecordBatch) -> dict[str, pa.RecordBatch]:
    lang = np.array(batch.column("lang").to_pylist(), object).astype(str)
    return {name: batch.take(pa.array(np.flatnonzero(lang == name))) for name in np.unique(lang).tolist()}


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often it occurs in texts with trained (0: in other texts only), slices: in how many slices of at most BATCH bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, rows in by_language(batch).items():
            g, n = grams_of(rows.column("text").to_pylist())
            which, kinds = pd.factorize(g)
            count = np.bincount(which, np.repeat(np.asarray(rows.column("trained")), n), len(kinds)).astype(np.int64)
            out.append(pa.RecordBatch.from_arrays([pa.array([name], pa.string()).take(pa.array(np.zeros(len(kinds), np.int32))), pa.array(kinds, pa.int64()), pa.array(count)], names=["lang", "gram", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches(1 << 30)[0] if any(x.num_rows for x in out) else out[0]

    return map_text(docs.select("lang", "trained", "text"), run, "lang string, gram long, n long", limit=BATCH).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("slices"))


def _mask(k: int) -> Column:
    return F.lit((1 << (BITS * k)) - 1)


def model(counts: DataFrame) -> DataFrame:
    """lang, gram, slices (if counts has them), nll: -log of the interpolated modified Kneser-Ney probability of the last character after the others, for each row of counts."""
    seen = counts.where("n > 0")
    lower: Column | None = None
    columns = [c for c in ("lang", "gram", "slices") if c in counts.columns]
    out = counts.select(*columns)
    for k in range(1, ORDER + 1):  # from single characters up
        if k == ORDER:
            table = seen.select("lang", F.col("gram").alias("g"), F.col("n").alias("c"))
        else:  # in how many kinds of longer grams does it end
            longer = seen.select("lang", F.col("gram").bitwiseAND(_mask(k + 1)).alias("l") if k + 1 < ORDER else F.col("gram").alias("l")).distinct()
            table = longer.groupBy("lang", F.col("l").bitwiseAND(_mask(k)).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        table = saved(table.withColumn("h", F.shiftrightunsigned("g", BITS)))
        of = lambda c: F.sum((F.col("c") == c).cast("double"))
        n1, n2, n3, n4 = (F.greatest(of(c), F.lit(0.0)) for c in (1, 2, 3, 4))
        y = F.when(n1 + 2 * n2 > 0, n1 / (n1 + 2 * n2)).otherwise(F.lit(0.5))
        part = lambda a, b, i: F.when(a > 0, F.greatest(F.lit(0.1), F.least(F.lit(i - 0.05), i - (i + 1) * y * b / a))).otherwise(F.lit(0.6 * i))
        discounts = table.groupBy("lang").agg(part(n1, n2, 1.0).alias("d1"), part(n2, n3, 2.0).alias("d2"), part(n3, n4, 3.0).alias("d3"))
        table = table.join(small(saved(discounts)), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = saved(table.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("off")))
        own = saved(table.join(small(context), ["lang", "h"]).select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("p")))
        gram = F.col("gram").bitwiseAND(_mask(k)) if k < ORDER else F.col("gram")
        out = out.withColumn("g", gram).withColumn("h", F.shiftrightunsigned("g", BITS))
        # Histories of few characters are hot, but few: they are broadcast. Long ones hold few grams each.
        out = out.join(small(context).select("lang", "h", (F.col("off") / F.col("total")).alias("back")), ["lang", "h"], "left").join(small(own), ["lang", "g"], "left")
        below = F.lit(1.0 / (1 << BITS)) if lower is None else F.col("below")
        out = out.select(*columns, (F.coalesce("p", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * below).alias("below"))
        out = saved(out)  # an order at a time: one plan of all orders takes hundreds of MB on the driver
        lower = F.col("below")
    return out.select(*columns, (-F.log("below")).alias("nll"))


def _chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of at most limit characters, or of one text."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def _packed(docs: DataFrame, size: int) -> DataFrame:
    """lang, batch, blob: documents of a language, an Arrow table compressed; batch is the blob's hash, so that a task that runs again gives the same."""

    def run(batches):
        held: dict[str, list[pa.RecordBatch]] = {}
        sizes: dict[str, int] = {}

        def blob(lang: str) -> pa.RecordBatch:
            sizes.pop(lang)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held.pop(lang)).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            data = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([xxhash.xxh64_intdigest(data) - (1 << 63)], pa.int64()), pa.array([data], pa.binary())], names=["lang", "batch", "blob"])

        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for batch in slices(whole, "text", size):
                for lang, rows in by_language(batch).items():
                    held.setdefault(lang, []).append(rows.drop_columns(["lang"]))
                    sizes[lang] = sizes.get(lang, 0) + rows.column("text").nbytes
                    if sizes[lang] > size:
                        yield blob(lang)
                while sum(sizes.values()) > 4 * size:
                    yield blob(max(sizes, key=sizes.get))
        for lang in sorted(held):
            yield blob(lang)

    return docs.select("lang", "doc_id", "row", "trusted", "text").mapInArrow(run, "lang string, batch long, blob binary")


def _sums(docs: DataFrame, table: DataFrame, size: int = PACKED) -> DataFrame:
    """doc_id, row, lang, trusted, length, sum of -log p of the texts of docs (doc_id, row, lang, trusted, text); table: a saved one of lang, gram, slices, nll.

    A gram stands once for each batch, so that a frequent one has about as many rows as slices: the hot ones are spread.
    """
    dealt = _packed(docs, size).repartition("lang", "batch")

    def wanted(batches):
        """Distinct grams of each batch."""
        for b in batches:
            for lang, number, blob in zip(*(b.column(c).to_pylist() for c in ("lang", "batch", "blob")), strict=True):
                texts = pa.ipc.open_stream(blob).read_all().column("text").to_pylist()
                kinds = np.unique(np.concatenate([np.unique(grams_of(texts[i:j])[0]) for i, j in _chunks(texts)]))
                zeros = pa.array(np.zeros(len(kinds), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(zeros), pa.array([number], pa.int64()).take(zeros), pa.array(kinds)], names=["lang", "batch", "gram"])

    def summed(blobs: pa.Table, grams: pa.Table) -> pa.Table:
        held, values = grams.column("gram").to_numpy(), grams.column("nll").to_numpy()
        order = np.argsort(held)
        held, values = held[order], values[order]
        out = []
        for lang, blob in zip(blobs.column("lang").to_pylist(), blobs.column("blob").to_pylist(), strict=True):
            rows = pa.ipc.open_stream(blob).read_all()
            texts = rows.column("text").to_pylist()
            lengths, sums = [], []
            for i, j in _chunks(texts):
                g, n = grams_of(texts[i:j])
                which, kinds = pd.factorize(g)
                nll = values[np.searchsorted(held, kinds)][which] if len(g) else np.zeros(0)
                total, ends = np.concatenate([[0.0], np.cumsum(nll)]), np.cumsum(n)
                lengths.append(n)
                sums.append(total[ends] - total[ends - n])
            rows = rows.drop_columns(["text"]).append_column("lang", pa.array([lang] * len(texts), pa.string()))
            out.append(rows.append_column("length", pa.array(np.concatenate(lengths))).append_column("nll", pa.array(np.concatenate(sums))))
        return pa.concat_tables(out).select(["doc_id", "row", "lang", "trusted", "length", "nll"])

    asked = dealt.mapInArrow(wanted, "lang string, batch long, gram long")
    answers = looked_up(asked, table, ["lang", "gram"], "slices", F.col("batch"), MODEL_BOUNDS).select("lang", "batch", "gram", "nll")
    return dealt.groupBy("lang", "batch").cogroup(answers.groupBy("lang", "batch")).applyInArrow(summed, "doc_id long, row long, lang string, trusted int, length long, nll double")


def with_trust(rows: DataFrame, ids: DataFrame, bounds: tuple[int, int] = (BROADCAST_ROWS, BROADCAST_BYTES)) -> DataFrame:
    """rows (doc_id, row, lang, text) with trusted, by a saved table of trusted ids.

    Batches are named by what a task packs, so a task that runs again must see its rows in the same order: those of a scan
    do, those of a shuffled join are sorted.
    """
    which = ids.withColumn("trusted", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0, F.lit(2)).otherwise(F.lit(1)))
    if is_small(ids, *bounds):
        out = rows.join(F.broadcast(which), "doc_id", "left")
    else:
        out = rows.join(which, "doc_id", "left").sortWithinPartitions("lang", "doc_id", "row")
    return out.withColumn("trusted", F.coalesce("trusted", F.lit(0)))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), lang, trusted (0: not, 1: trained on, 2: held out), length, perplexity."""
    trust = saved(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("lang"), text.alias("text"))
    rows = with_trust(rows, trust)
    counts = saved(gram_counts(rows.select("lang", "text", (F.col("trusted") == 1).alias("trained"))))
    sums = _sums(rows, saved(model(counts)))
    return saved(sums.select("doc_id", "row", "lang", "trusted", "length", F.when(F.col("length") > 0, F.exp(F.col("nll") / F.col("length"))).alias("perplexity")))


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, row, lang, trusted, length, perplexity, threshold, keep."""
    rows = perplexities(docs, labels)
    rows = rows.withColumn("band", F.greatest(F.lit(BANDS[0]), F.least(F.lit(BANDS[1]), F.floor(F.log2(F.greatest(F.col("length"), F.lit(1)))).cast("int") + 1)))
    found = saved(rows.where("trusted = 2 and perplexity is not null").groupBy("lang", "band").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)).alias("q")))
    grid = found.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(BANDS[0]), F.lit(BANDS[1]))).alias("band")).join(found, ["lang", "band"], "left")
    near = Window.partitionBy("lang").orderBy("band")
    down, up = F.last("q", True).over(near.rowsBetween(Window.unboundedPreceding, 0)), F.first("q", True).over(near.rowsBetween(0, Window.unboundedFollowing))
    grid = saved(grid.select("lang", "band", (margin * F.coalesce(down, up)).alias("threshold")))
    rows = rows.join(small(grid), ["lang", "band"], "left")
    keep = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return rows.select("doc_id", "row", F.when(F.col("lang") != "-", F.substring("lang", 2, 1 << 30)).alias("lang"), "trusted", "length", "perplexity", "threshold", keep.alias("keep"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' columns."""
    doc, row = free_names(docs, "_id", "_row")
    good = saved(classified(docs, labels).where("keep").select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(small(good), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(row)), "left_semi")


def op5_quality_perplexity(spark, sf_dir: str) -> DataFrame:
    out = classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "lang", "length", "perplexity", "threshold", F.col("keep").cast("int").alias("keep"))
