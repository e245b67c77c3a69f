"""N-gram Jaccard join: connected components of documents whose shingle sets are similar, found exactly.

Method. Sets of equal content collapse into one representative. A set of n shingles is dealt by hash into the
P parts of its size band, with P above the largest symmetric difference that a similar pair of the band can have;
so a similar pair has a part in which both hold the same shingles (pigeonhole), however frequent single shingles are.
A set whose shingles fall into so few parts that this might fail is dealt by a next hash, too (TURNS of them).
Among the sets that share a part, bit counts of hashed bitmaps bound the overlap from above; a spanning forest of the
admitted pairs goes on, never the pairs; where more than GROUP sets share a part, all of them go on as a star. Parts that
very many sets share show in a sample of the sets; their rows are stars at once and are spread over all tasks. Their
components are families, which hold all similar pairs. A family's sets, ordered by size, are cut into blocks of a bounded
number of shingles; each two blocks whose sizes are compatible make a tile. In a tile wider bitmaps admit pairs that are
not connected yet, and the sorted sets are intersected exactly.
Components need only the tiles of a family's first block and of each block with itself, and of the others the rows that
are in several components after those. Where links are counted, all tiles intersect all their pairs of different sets
exactly (tile_counts) and yield a sum for each set, never the pairs; each pair belongs to one tile.

Defined cases: no text or no words: an empty set, linked with nothing. Fewer words than a shingle has: the whole
sequence is the one shingle. Rows that share a doc_id are one document. A null doc_id: class_id and component_id null, no
link. Extra columns are ignored. An empty table gives an empty result. Very long texts are sets like others; one that has
more shingles than a block is a block.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, looked_up, map_text, ranked, saved, small

#: Ratio of neighbouring size bands, sets of a group that a task compares with each other, shingles of a tile's side, hashes that deal a set into parts.
BAND, GROUP, SIDE, TURNS = 0.62, 16384, 1_000_000, 8
#: Bytes of text or of sets that a task works on at a time.
BATCH = 1 << 20
#: Of so many documents one looks for parts that many sets share, but not of fewer than SAMPLED; such a part has LIKELY of them.
ONE_OF, SAMPLED, LIKELY = 64, 100_000, 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the lower-cased (A-Z) text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, m = max(1, len(words) - k + 1), min(k, len(words))
    h = np.full(n, m, np.uint64)
    for i in range(m):
        h = _mix((h * np.uint64(0x9E3779B97F4A7C15)) ^ w[i : i + n])
    return np.unique(h)


def bands(top: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, parts) of the bands up to size top. A pair belongs to the band of its smaller set."""
    out, low = [], 1
    while low <= top:
        high = max(low, int(np.ceil(low / BAND)) - 1)
        differ = (high + high * den // num) * (den - num) // (den + num)
        out.append((low, high, 0 if differ == 0 else differ + 1 + (differ + 1) // 8 + 2))
        low = high + 1
    return out


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """A hash for each part of the band of a set's own size, and of the bands in which it can be the larger set.

    If a similar pair agrees in no part that holds a shingle, each part that holds one differs, so both sets are in at
    most as many parts as the pair can differ in shingles. Such sets are dealt by the next hash, too; after the last one
    they share a constant.
    """
    n, out = len(s), []
    for b, (low, high, parts) in enumerate(bands(n, num, den)):
        if not parts or high * den // num < n:
            continue
        differ = (high + high * den // num) * (den - num) // (den + num)
        for turn in range(TURNS):
            tag = b + (turn << 16)
            part = ((_mix(s + np.uint64(tag)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[order], prepend=np.uint64(1 << 40)))
            total = np.add.reduceat(_mix(s[order] ^ np.uint64(0x5851F42D4C957F2D)), first)
            out.append(_mix(total ^ _mix(part[order][first] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(tag + 1))))
            if len(first) > differ:
                break
        else:
            out.append(_mix(np.array([b + (1 << 40)], np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def bitmap(s: np.ndarray, bits: int = 0) -> bytes:
    """A hashed bitmap of bits, or of as many as the next power of two has from the set's size on, at least 64."""
    bits = bits or max(64, 1 << int(max(1, len(s) - 1)).bit_length())
    x = np.zeros(bits, np.uint8)
    x[(_mix(s ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(x, bitorder="little").tobytes()


def _folded(rows: list[bytes], words: int) -> np.ndarray:
    return np.stack([np.bitwise_or.reduce(np.frombuffer(r, np.uint64).reshape(-1, words), axis=0) for r in rows])


def _bound(n: int, m: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Can sets of n and m shingles have the similarity if their bitmaps differ in so many bits?"""
    return ((n + m - differ) // 2 * (den + num) >= num * (n + m)) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)


class Forest:
    """Union-find over rows of a task."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = [[i] for i in range(n)]
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.edges.append((a, b))
            if len(self.members[x]) < len(self.members[y]):
                x, y = y, x
            self.of[self.members[y]] = x
            self.members[x] += self.members[y]
            self.members[y] = []


def group_forest(n: np.ndarray, bits: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect the rows (ordered by n) of each component of the admitted pairs."""
    forest, folded, words = Forest(len(n)), {}, np.array([len(x) // 8 for x in bits])

    def at(w: int) -> np.ndarray:
        if w not in folded:
            folded[w] = _folded(bits[int(np.searchsorted(words, w)) :], w)
        return folded[w]

    for x in range(len(n) - 1):
        end = int(np.searchsorted(n, int(n[x]) * den // num, side="right"))
        y = x + 1 + np.flatnonzero(forest.of[x + 1 : end] != forest.of[x])
        while len(y):
            part, y = y[:512], y[512:]
            first = int(np.searchsorted(words, words[x]))
            differ = np.bitwise_count(at(words[x])[part - first] ^ at(words[x])[x - first]).sum(axis=1)
            ok = part[_bound(int(n[x]), n[part], differ, num, den)]
            for z in ok:
                forest.join(x, int(z))
            if len(ok) and len(y):
                y = y[forest.of[y] != forest.of[x]]
    return forest.edges


def tile_links(sets: list[np.ndarray], num: int, den: int, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect the rows (ordered by size) of each component of the similar pairs; exact."""
    forest, n = Forest(len(sets)), np.array([len(s) for s in sets])
    wide = max(64, 1 << int(8 * n[-1] - 1).bit_length())
    bits = np.stack([np.frombuffer(bitmap(s, wide), np.uint64) for s in sets])
    for x in range(len(n) - 1):
        end = int(np.searchsorted(n, int(n[x]) * den // num, side="right"))
        y = x + 1 + np.flatnonzero(forest.of[x + 1 : end] != forest.of[x])
        if own is not None:
            y = y[own[y] != own[x]]
        for part in np.array_split(y, max(1, len(y) * bits.shape[1] // (1 << 20))):
            differ = np.bitwise_count(bits[part] ^ bits[x]).sum(axis=1)
            ok = _bound(int(n[x]), n[part], differ, num, den)
            for z in part[ok][np.argsort(differ[ok], kind="stable")]:  # the likeliest first
                if forest.of[z] != forest.of[x] and similar(sets[x], sets[z], num, den):
                    forest.join(x, int(z))
    return forest.edges


def tile_counts(sets: list[np.ndarray], num: int, den: int, own: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Similar rows (ordered by size) of each row, and edges that connect the components; exact, over all pairs.

    Shingles of many sets are bits of a matrix whose common bits are counted; those of few sets have lists of their sets.
    """
    forest, n = Forest(len(sets)), np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    held, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(shingle, minlength=len(held))
    many = df * 16 > len(sets)
    column = np.cumsum(many) - 1
    words = int(many.sum()) // 64 + 1
    bits, start = np.zeros((len(sets), words), np.uint64), np.concatenate([[0], np.cumsum(df)])
    lists = row[np.argsort(shingle, kind="stable")]
    at, ends = many[shingle], np.concatenate([[0], np.cumsum(n)])
    np.bitwise_or.at(bits, (row[at], column[shingle[at]] // 64), np.uint64(1) << (column[shingle[at]] % 64).astype(np.uint64))
    links = np.zeros(len(sets), np.int64)
    for x in range(len(n) - 1):
        end = int(np.searchsorted(n, int(n[x]) * den // num, side="right"))
        if end <= x + 1:
            continue
        both = np.concatenate([np.bitwise_count(bits[i : min(end, i + (1 << 20) // words + 1)] & bits[x]).sum(axis=1, dtype=np.int64) for i in range(x + 1, end, (1 << 20) // words + 1)])
        few = shingle[ends[x] : ends[x + 1]]
        few = few[~many[few] & (df[few] > 1)]
        if len(few):
            size = df[few]
            z = lists[np.repeat(start[few] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            both += np.bincount(z[(z > x) & (z < end)] - (x + 1), minlength=end - x - 1)
        ok = both * den >= (n[x] + n[x + 1 : end] - both) * num
        if own is not None:
            ok &= own[x + 1 : end] != own[x]
        y = x + 1 + np.flatnonzero(ok)
        links[x] += len(y)
        links[y] += 1
        while len(y := y[forest.of[y] != forest.of[x]]):
            forest.join(x, int(y[0]))
    return links, forest.edges


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Exact intersection of two sorted arrays."""
    if not len(a) or not len(b) or min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = int(np.count_nonzero(np.isin(a, b, assume_unique=True, kind="sort")))
    return both * den >= (len(a) + len(b) - both) * num


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and digest of the set of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())], names=["doc_id", "n", "digest"])

    return map_text(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, digest binary", limit=BATCH)


def representatives(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """doc_id, digest, n, bitmap and set (sorted hashes) of the document that stands for each class."""
    wanted = classes.select(F.col("class_id").alias("doc_id"), "digest")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(small(wanted), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in batch.column("text").to_pylist()]
        at = [i for i, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist(), strict=True)) if _digest(s) == d]
        sets = [sets[i] for i in at]
        own = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(bitmap, sets)), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "digest", "n", "bits", "set"])

    return map_text(texts.select("doc_id", "text", "digest"), run, "doc_id long, digest binary, n long, bits binary, set binary", limit=BATCH)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of a graph's edges (a, b), component being the smallest node: large-star and small-star in turn."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("rows")))
        large = looked_up(both.where("b > a"), low, ["a"], "rows", F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large)
        low = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows")))
        edges = looked_up(large, low, ["a"], "rows", F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(edges.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    out = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def _grouped(rows: DataFrame, by: list[str], columns: list[str], find) -> DataFrame:
    """(a, b, digest, n) that find(list of rows) yields for each group of rows, which stand together in a partition."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])
        out = lambda found: pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][: len(by)] != row[: len(by)]:
                    found.extend(find(group))
                    group = []
                group.append(row)
            yield out(found)
        if group:
            yield out(list(find(group)))

    return rows.select(*by, *columns).mapInArrow(run, "a long, b long, digest binary, n long")


def _edges(found: DataFrame) -> DataFrame:
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _families(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component): representatives that may be similar are in one component."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [signatures(np.frombuffer(x, np.uint64), num, den) for x in batch.column("set").to_pylist()]
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return pa.RecordBatch.from_arrays([pa.array(_longs(np.concatenate(sets))), batch.column("doc_id").take(pa.array(at))], names=["sig", "doc_id"])

    signed = lambda some: map_text(some.select("doc_id", "set"), sign, "sig long, doc_id long", limit=BATCH, column="set")
    one_of = max(ONE_OF, reps.count() // SAMPLED)
    hot = signed(reps.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_of)) == 0)).groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("centre"))
    hot = saved(hot.where(F.col("n") >= LIKELY).drop("n"))  # at most 1 / LIKELY of the sample's rows
    rows = signed(reps).join(F.broadcast(hot), "sig", "left").withColumn("salt", F.when(F.col("centre").isNull(), F.lit(0)).otherwise(F.pmod(F.hash("doc_id"), F.lit(1 << 20)) + 1))
    own = Window.partitionBy("sig", "salt")
    rows = rows.select("sig", "doc_id", F.count(F.lit(1)).over(own).alias("rows"), F.col("centre").isNotNull().alias("hot"), F.coalesce("centre", F.min("doc_id").over(own)).alias("centre"))
    rows = saved(rows.where("hot or rows > 1").select("sig", "doc_id", "centre", (F.col("hot") | (F.col("rows") > GROUP)).alias("many")))
    stars = rows.where("many").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    # A merge by doc_id, even of a small table: rows of a document then follow each other, and the shuffle compresses their bitmaps.
    dealt = rows.where("not many").select("sig", "doc_id").join(reps.select("doc_id", "n", "bits").hint("merge"), "doc_id").repartition("sig").sortWithinPartitions("sig", "n", "doc_id")

    def find(group: list[tuple]):
        for x, y in group_forest(np.array([g[2] for g in group], np.int64), [g[3] for g in group], num, den):
            yield group[x][1], group[y][1], None, None

    return components(_edges(_grouped(dealt, ["sig"], ["doc_id", "n", "bits"], find)).unionByName(stars))


def _blocks(reps: DataFrame, families: DataFrame) -> DataFrame:
    """family, block, doc_id, digest, n: a family's sets by size, in blocks of SIDE shingles."""
    members = families.select(F.col("component").alias("family"), F.col("node").alias("doc_id")).join(reps.select("doc_id", "digest", "n"), "doc_id")
    members = saved(members.dropDuplicates(["doc_id", "digest"]))
    sizes = members.groupBy("family", "n").agg(F.count(F.lit(1)).alias("rows"))
    below = Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = saved(sizes.withColumn("below", F.coalesce(F.sum(F.col("n") * F.col("rows")).over(below), F.lit(0))))
    members = ranked(members, ["family", "n"], [F.col("doc_id"), F.col("digest")], "rank", F.xxhash64("doc_id", "digest"))
    members = looked_up(members, sizes, ["family", "n"], "rows", F.xxhash64("doc_id", "digest"))
    return saved(members.select("family", F.floor((F.col("below") + F.col("rank") * F.col("n")) / SIDE).cast("int").alias("block"), "doc_id", "digest", "n"))


def _tiles(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """family, i, j of each two blocks that can hold a similar pair."""
    left, right = (blocks.select("family", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high"))) for s in "ij")
    return left.join(right, "family").where(f"block_i <= block_j and low_j * {num} <= high_i * {den}").select("family", F.col("block_i").alias("i"), F.col("block_j").alias("j"))


def _found(placed: DataFrame, reps: DataFrame, num: int, den: int, count: bool) -> DataFrame:
    """What the tiles (family, i, j) yield of the sets placed (block, doc_id, digest) in them."""
    dealt = reps.select("doc_id", "digest", "n", "set").join(small(saved(placed)), ["doc_id", "digest"]).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "n", "doc_id", "digest")

    def find(group: list[tuple]):
        sets = list({(g[4], g[5]): (g[3], g[4], g[5], np.frombuffer(g[6], np.uint64)) for g in group}.values())
        if len(sets) > 1:
            own = np.array([x[0] for x in sets]) if group[0][1] != group[0][2] else None
            if count:
                links, edges = tile_counts([s[3] for s in sets], num, den, own)
                yield from ((s[1], None, s[2], int(n)) for s, n in zip(sets, links, strict=True) if n)
            else:
                edges = tile_links([s[3] for s in sets], num, den, own)
            yield from ((sets[x][1], sets[y][1], None, None) for x, y in edges)

    return _grouped(dealt, ["family", "i", "j"], ["block", "doc_id", "digest", "set"], find)


def _links(reps: DataFrame, families: DataFrame, num: int, den: int, count: bool) -> DataFrame:
    """Edges (a, b) of similar sets that connect what is connected by similar sets.

    count: also (a, null, digest, n) with a tile's number of links of a representative (doc_id a, digest).
    """
    rows = _blocks(reps, families)
    tiles = saved(_tiles(rows.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), num, den))
    members = rows.select("family", "block", "doc_id", "digest")
    place = lambda t, m: m.join(t.select("family", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j"), ["family", "block"])
    if count:
        return saved(_found(place(tiles, members), reps, num, den, True))
    first = saved(_found(place(tiles.where("i = j or i = 0"), members), reps, num, den, False))
    rest = tiles.where("i > 0 and i < j")
    if rest.isEmpty():
        return first
    known = saved(components(_edges(first)))
    members = saved(members.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    one = members.groupBy("family", "block").agg(F.min("component").alias("least"), F.max("component").alias("most")).withColumn("only", F.when(F.col("least") == F.col("most"), F.col("least")))
    sides = [rest.select("family", F.col(own).alias("block"), F.col(other).alias("other"), "i", "j") for own, other in (("i", "j"), ("j", "i"))]
    dealt = sides[0].unionByName(sides[1]).join(one.select("family", F.col("block").alias("other"), "only"), ["family", "other"]).join(members, ["family", "block"])
    dealt = dealt.where("only is null or only <> component").select("family", "block", "doc_id", "digest", "i", "j")
    return first.unionByName(saved(_found(dealt, reps, num, den, False)))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: str = "0.8", count: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id for each row of docs.

    count: also n_links, the number of other sets (classes) that are similar to the row's own.
    """
    num, den = Fraction(similarity).as_integer_ratio()
    rows = saved(features(docs, k))
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = saved(classes.where("class_id is not null"))
    reps = saved(representatives(docs, classes, k))
    links = _links(reps, _families(reps, num, den), num, den, count)
    edges = _edges(links)
    full = rows.where("n > 0 and doc_id is not null")
    several = saved(full.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id"))
    if not several.isEmpty():  # documents of several texts
        theirs = saved(looked_up(full.join(small(several), "doc_id"), classes, ["digest"], "copies", F.col("doc_id")))
        edges = edges.unionByName(theirs.join(theirs.groupBy("doc_id").agg(F.min("class_id").alias("a")), "doc_id").select("a", F.col("class_id").alias("b")))
    found = components(edges)
    named = classes.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id")).drop("component")
    if count:
        sums = links.where("b is null").groupBy("digest").agg(F.sum("n").alias("n_links"))
        named = named.join(sums, "digest", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    counts = ["n_links"] if count else []
    named = looked_up(full, saved(named), ["digest"], "copies", F.col("doc_id")).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", *counts)
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), *(F.lit(0).cast("long").alias(c) for c in counts))
    return named.unionByName(rest)


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 4, "0.85", count=True)
