"""Document fingerprints [native]: I-Match over several randomised lexicons.

Method. The lexicon holds all terms but the common ones, those in more than a share of the documents, near copies being
counted once: so rare languages and large groups of near copies keep their terms. At most (mean number of distinct terms
in a document) / (share) terms are common however many documents there are, and the plan holds their hashes as literals.
A document keeps its lexicon terms, distinct and sorted (by hash). The lexicon is cut into random subsets: level j keeps
the terms whose hashes end in j zero bits and deals them into LANES lanes by other bits. A document hashes its terms of
each lane of two neighbouring levels, those in which it has some one term a lane, so that long and short documents have
lanes that an edit leaves whole. A fingerprint is the lower level and the hashes of its lanes; two without a common level
(documents of four times as many terms) have likeness 0.

The likeness of two fingerprints comes from the levels that both have: of the lanes that hold a term in either document,
the share that agrees gives the share of terms in common (of a lane of random size, which is inverted: lanes of more
terms break sooner), as twice the common terms over the sum of both. No agreeing lane gives 0, all of them give 1.

Near copies are found by the least hash of three terms that follow each other: of the documents that share two of
ROUNDS such hashes one is counted, for each two of them in turn.

Defined cases: a null text is empty. A text of fewer than FEW lexicon terms keeps its common terms, too. A text without
terms gets lanes from the hash of its lower-cased text. Rows that share a doc_id follow each other by text, largest
first; null doc_ids come last in descending order and are one stretch. doc_ids may be any 64-bit numbers, however they
lie. Extra columns are ignored. An empty table gives an empty result. Very long texts are fingerprinted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved, small

#: Share of the documents above which a term is common (at least 2 documents); lexicon terms a text has without its common ones.
MOST, FEW = 1 / 20, 4
#: Hashes by which near copies are left out of the counts.
ROUNDS = 3
#: Lanes of a level, terms that the lower one of a document's two levels has at least (level 0 excepted) and at most twice that.
LANES, TERMS = 32, 24
DIGITS, NONE = 4, "...."
#: Rows of a stretch of doc_ids, and the most stretches (a square number): beyond them, stretches hold more rows.
STRETCH, STRETCHES = 4096, 16384


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, lower case; the empty string may stand first or last."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _once(value: Column, f) -> Column:
    """f(value), value being computed once as a lambda's argument."""
    return F.transform(F.array(value), f)[0]


def counted_once(docs: DataFrame) -> DataFrame:
    """text of one document of each group of copies and near copies; rows alike in doc_id and text stay together."""
    shingles = lambda t: F.transform(t, lambda x, i: F.xxhash64(x, F.get(t, i + 1), F.get(t, i + 2)))
    salted = lambda k: lambda x: F.xxhash64(F.lit(k), x)
    least = lambda s: F.array(*(F.array_min(F.transform(s, salted(k))) for k in range(ROUNDS)))
    hashed = docs.select("text", F.xxhash64("text").alias("h"), F.coalesce("doc_id", F.lit(-1)).alias("id"))
    first = hashed.select("h", "id", _once(terms_of(F.col("text")), lambda t: _once(shingles(t), least)).alias("keys"))
    for k in range(ROUNDS):
        first = first.groupBy(F.col("keys")[k], F.col("keys")[(k + 1) % ROUNDS]).agg(F.min(F.struct("h", "id", "keys")).alias("f")).select("f.*")
    return hashed.join(small(saved(first.select("h", "id"))), ["h", "id"], "left_semi").select("text")


def common_terms(docs: DataFrame, most: float = MOST) -> dict[str, int]:
    """Terms, with their hashes, in more than a share of the documents; at most (mean number of distinct terms of a document) / most of them."""
    pairs = counted_once(docs).select(F.explode(F.array_append(F.array_distinct(terms_of(F.col("text"))), F.lit("\n"))).alias("term"))
    counted = saved(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    # Each document has the mark "\n" beside its terms, so that they are counted in the same pass.
    n = counted.where("term = '\\n'").agg(F.max("df")).first()[0] or 0
    found = counted.where((F.col("df") > max(2.0, most * n)) & ~F.col("term").isin("", "\n"))
    return {r.term: r.hash for r in found.select("term", F.xxhash64("term").alias("hash")).orderBy("term").collect()}


def print_of(text: Column, common: dict[str, int]) -> Column:
    """struct of level and lanes: 16-bit hashes of the lanes of that level and of the next, null where a lane holds no term."""
    part = lambda h: h.bitwiseAND((1 << 4 * DIGITS) - 1).cast("int")
    hashes = F.transform(F.filter(terms_of(text), lambda x: x != ""), lambda x: F.xxhash64(x))
    every = F.array_sort(F.array_distinct(hashes))
    own = lambda t: _once(F.filter(t, lambda x: ~x.isin(list(common.values()))) if common else t, lambda rare: F.when(F.size(rare) < FEW, t).otherwise(rare))
    held = lambda t, level: F.filter(t, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1) == 0)
    lane = lambda x, level: F.call_function("shiftrightunsigned", x, 20 + 5 * (level % 8)).bitwiseAND(LANES - 1)
    empty = F.xxhash64(F.array().cast("array<bigint>"))

    def lanes(t: Column, level: Column) -> Column:
        sums = lambda kept: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.xxhash64(F.filter(kept, lambda x: lane(x, level) == i)))
        return F.transform(_once(held(t, level), sums), lambda x: F.when(x != empty, part(x)))

    def both(t: Column) -> Column:
        level = F.greatest(F.lit(0), F.floor(F.log2(F.size(t) / F.lit(float(TERMS)))).cast("int"))
        return _once(level, lambda j: F.struct(j.alias("level"), F.concat(lanes(t, j), lanes(t, j + 1)).alias("lanes")))

    without = F.struct(F.lit(0).alias("level"), F.transform(F.sequence(F.lit(0), F.lit(2 * LANES - 1)), lambda k: part(F.xxhash64(k, F.lower(text)))).alias("lanes"))
    return _once(_once(every, own), lambda t: F.when(F.size(t) == 0, without).otherwise(both(t)))


def fingerprint(p: Column) -> Column:
    lanes = F.transform(p["lanes"], lambda x: F.when(x.isNull(), F.lit(NONE)).otherwise(F.lpad(F.hex(x), DIGITS, "0")))
    return F.concat(F.lpad(p["level"].cast("string"), 2, "0"), F.lit(":"), F.array_join(lanes, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of terms in common (twice the common ones over the sum of both), estimated from the levels that both prints have."""

    def level(x: Column, y: Column) -> Column:
        """Weight (lanes that hold a term) and estimate of one level: lanes agree with probability exp(-d), d the terms a lane that differ; are empty with exp(-all of them)."""
        kinds = F.zip_with(x, y, lambda p, q: F.when(p.isNull() & q.isNull(), F.lit(0)).when(F.coalesce(p == q, F.lit(False)), F.lit(1)).otherwise(F.lit(2)))
        count = lambda k, v: F.size(F.filter(k, lambda z: z == v))
        share = lambda n: F.log((n + 0.5) / (LANES + 0.5))

        def estimate(k: Column) -> Column:
            none, same = count(k, 0), count(k, 1)
            return F.when(none == LANES, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("like"))).otherwise(F.struct((LANES - none).alias("n"), (1 - share(none + same) / share(none)).alias("like")))
        return _once(kinds, estimate)

    low, high = (lambda p: F.slice(p["lanes"], 1, LANES)), (lambda p: F.slice(p["lanes"], LANES + 1, LANES))
    step = b["level"] - a["level"]
    found = F.when(step == 0, F.array(level(low(a), low(b)), level(high(a), high(b)))).when(step == 1, F.array(level(high(a), low(b)))).when(step == -1, F.array(level(low(a), high(b))))
    total = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("x")), lambda s, e: F.struct((s["n"] + e["n"]).alias("n"), (s["x"] + e["n"] * e["like"]).alias("x")), lambda s: F.when(s["n"] > 0, s["x"] / s["n"]).otherwise(F.lit(0.0)))
    return _once(F.coalesce(total, F.lit(0.0)), lambda j: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * j / (1 + j))))


def _literal(numbers: list[int]) -> Column:
    """An array of longs as one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def stretch_of(docs: DataFrame, rows: int = STRETCH, most: int = STRETCHES) -> Column:
    """The number of a doc_id's stretch, ascending: how many of the bounds, quantiles of all doc_ids, are up to it; -1 for null."""
    n = docs.count()
    k = min(most, n // rows + 1)
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / k) for i in range(1, k))), F.lit(max(10_000, 20 * k)))).first()[0] if k > 1 else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    side = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    upto = lambda numbers: F.size(F.filter(numbers, lambda b: b <= F.col("doc_id")))
    group = F.greatest(upto(_literal([g[0] for g in groups])) - 1, F.lit(0))
    inner = F.split(F.element_at(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), group + 1), ",").cast("array<bigint>")
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(group * side + upto(inner))


def followed(docs: DataFrame, own, rows: int = STRETCH) -> DataFrame:
    """doc_id, text, own (own(text)), next_text, next_own: those of the row after it in descending order of doc_id, of the first row for the last."""
    stretch = stretch_of(docs, rows)
    docs = docs.select("doc_id", "text", stretch.alias("stretch"))
    # The first row of each stretch, from doc_ids alone; texts of those rows only.
    table = saved(docs.groupBy("stretch").agg(F.max("doc_id").alias("doc_id")))
    heads = docs.join(F.broadcast(table.select(F.col("stretch").alias("s"), F.col("doc_id").alias("d"))), (F.col("stretch") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")))
    heads = heads.groupBy("stretch").agg(F.max("text").alias("head"))
    every = Window.orderBy("stretch")
    order = table.select("stretch", F.coalesce(F.lag("stretch").over(every), F.max("stretch").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    heads = saved(order.join(heads.withColumnRenamed("stretch", "next"), "next").select("stretch", "head", own(F.col("head")).alias("head_own")))
    w = Window.partitionBy("stretch").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    out = docs.withColumn("own", own(F.col("text"))).select("*", F.lead("text").over(w).alias("next_text"), F.lead("own").over(w).alias("next_own"))
    out = out.join(heads, "stretch")
    last = F.col("next_text").isNull()
    return out.select("doc_id", "text", "own", F.when(last, F.col("head")).otherwise(F.col("next_text")).alias("next_text"), F.when(last, F.col("head_own")).otherwise(F.col("next_own")).alias("next_own"))


def op6_imatch(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common = common_terms(docs)
    rows = followed(docs, lambda text: print_of(text, common))
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", print_of(F.col("edited"), common).alias("edited"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
