"""Line dedup [native]: a line that several documents hold stays only in the one with the smallest doc_id.

Method. Hashes of the lines' keys are dealt by range (the leading bits of a uniform hash) and sorted by hash, document
and position; a running minimum streams through the sorted rows and keeps only the first document of each hash, so
nothing is gathered per line. It runs twice: first within shares of each hash by document, as many as split a line that
all documents hold into parts of at most PER_SHARE documents, then over the few first documents of those shares; the
marks of the first run are written, so that lines are cut and hashed once. What is returned are compressed keep bitmaps
of each document: 63 lines a word, a bit for each line that stays, words that keep all lines left out; a document without
a bitmap keeps all its lines.

Defined cases: a null or empty text is one empty line. Keys under min_chars code points never count. Rows with one
doc_id are one document: repeats within it stay. A null doc_id counts as the largest. Extra columns stay, whatever their
names. A very long text is as many rows as it has lines. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_names, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The least number of shares, documents of a share that may hold a line.
SHARES, PER_SHARE = 16, 1 << 20
#: Ranges of the hash are its leading bits.
RANGE_BITS = 14
WORD_BITS = 63
FULL = (1 << WORD_BITS) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, row (hash of the text), kept: map of word number to the bits of its lines that stay, without words that keep all. Documents that keep all have no row."""
    shares = max(SHARES, -(-docs.count() // PER_SHARE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(F.col("text")).alias("row"), lines_of(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", "row", F.posexplode_outer("lines").alias("pos", "line"))  # below: the text is hashed and split once
    key = F.translate(F.btrim("line", F.lit(" \t\n\x0b\f\r")), UPPER, LOWER)
    order = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    rows = rows.withColumn("key", key).where(F.length("key") >= min_chars)
    rows = rows.select("doc_id", "row", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"), order.alias("d"))
    rows = rows.withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS)).withColumn("share", F.pmod(F.xxhash64("d"), F.lit(shares)))

    def streamed(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by, "h", "g").orderBy("d", "pos").rowsBetween(Window.unboundedPreceding, 0)
        return df.repartition(*by).withColumn("later", F.col("d") > F.min("d").over(w))

    one = saved(streamed(rows, "range", "share").select("doc_id", "row", "pos", "h", "g", "range", "later"))
    two = streamed(one.where("not later").drop("later").withColumn("d", order), "range")
    drops = one.where("later").select("doc_id", "row", "pos").unionByName(two.where("later").select("doc_id", "row", "pos"))
    bit = F.expr(f"shiftleft(1L, pos % {WORD_BITS})")
    words = drops.groupBy("doc_id", "row", F.expr(f"pos div {WORD_BITS}").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).bitwiseAND(F.lit(FULL)).alias("bits"))
    return words.groupBy("doc_id", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("kept"))


def _marked(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the lines of its texts and the bitmap without gaps (null: all lines stay), and the names of these two."""
    doc, row, kept, lines, words = free_names(docs, "_id", "_row", "_kept", "_lines", "_words")
    right = bitmaps.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("kept").alias(kept))
    out = docs.join(right, docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (_row(docs["text"]) == F.col(row)), "left").withColumn(lines, lines_of(F.col("text")))
    every = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size({lines}) - 1) div {WORD_BITS} as int)")), lambda w: F.coalesce(F.element_at(kept, w.cast("long")), F.lit(FULL)))
    return out.withColumn(words, F.when(F.col(kept).isNotNull(), every)).drop(doc, row, kept), lines, words


def _kept(lines: str, words: str) -> Column:
    """The text without its dropped lines."""
    return F.expr(f"if({words} is null, coalesce(text, ''), array_join(filter({lines}, (x, i) -> (shiftright(element_at({words}, cast(i div {WORD_BITS} as int) + 1), i % {WORD_BITS}) & 1L) = 1), '\\n'))")


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs, their text with the lines that the bitmaps keep; a text that loses nothing stays as it is, null too."""
    columns = docs.columns
    out, lines, words = _marked(docs, bitmaps)
    return out.withColumn("text", F.when(F.col(words).isNull(), F.col("text")).otherwise(_kept(lines, words))).select(*columns)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out, lines, words = _marked(docs, line_bitmaps(docs))
    dropped = F.coalesce(F.expr(f"aggregate({words}, 0L, (n, w) -> n + {WORD_BITS} - bit_count(w))"), F.lit(0).cast("long"))
    return out.select("doc_id", F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.sha2(_kept(lines, words), 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM x),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > f.first_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
