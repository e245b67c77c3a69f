"""Prefix trie of conversations: nodes with their members, subtrees and the tokens that sharing prefixes saves.

Method. A conversation is an array of digests of its turns (role and text). The arrays are sorted globally by range, equal
ones by conversation. Within a range a stack holds the nodes on the path of the current array: the longest common prefix
(LCP) with the next array says how many of them end there, and an ended node passes its sums on to its parent. The
nodes on the paths of a range's first and last array may go on in other ranges: they leave as open stacks, one row for
each range, and a second sweep over these rows in turn merges and closes them in the same way. What it holds is bounded
by the number of ranges times the length of a conversation, whatever the number of conversations. A node is named by a
digest chained over its prefix; its parent's smallest member, known only when the parent ends, comes by a join by that
name, in which parents of many children are spread. Members that end at a node stand together in the sorted order and are
hashed as they pass; where equal arrays lie in several ranges, their members are hashed in a pass of their own.

Defined cases: turns are ordered by turn (null first), then role, then text; null role or text is empty. Rows without
conv_id belong to no conversation and are left out. Rows that repeat are turns that repeat. A conversation without turns is
a member of the root only. A conversation is one array of digests in one task, however long; its texts are not gathered.
Extra columns are ignored. An empty table has no conversations and gives no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, saved

#: Conversations of a range, least number of ranges.
PER_RANGE, RANGES = 1 << 16, 16
TURN = "struct<digest: binary, size: long>"


def turn_arrays(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (digest, bytes of the text) in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    rows = rows.select("conv_id", F.row_number().over(order).alias("at"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest", "size"))), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def grafted(convs: DataFrame, parent: Column, head: Column) -> DataFrame:
    """convs (saved; conv_id, turns) with their first turns replaced: the first head turns of the conversation named parent, then their own after as many."""
    own = convs.select("conv_id", "turns", parent.cast("long").alias("_parent"), head.cast("int").alias("_head"))
    other = convs.select(F.col("conv_id").alias("_parent"), F.col("turns").alias("_turns"))
    none = F.array().cast(f"array<{TURN}>")
    first = F.slice(F.coalesce("_turns", none), F.lit(1), F.col("_head"))
    return own.join(other, "_parent", "left").select("conv_id", F.concat(first, F.slice("turns", F.col("_head") + 1, F.size("turns"))).alias("turns"))


class Node:
    """What is known of a node: its depth and name, and sums over what has passed of it."""

    __slots__ = ("bytes", "children", "convs", "depth", "ends", "first", "leaves", "name", "saved")

    def __init__(self, depth: int, name: bytes, size: int):
        self.depth, self.name, self.bytes = depth, name, size
        self.first: int | None = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends: str | None = None

    def pack(self) -> dict:
        return {k: getattr(self, k) for k in self.__slots__}

    @classmethod
    def unpack(cls, row: dict) -> Node:
        node = cls(row["depth"], row["name"], row["bytes"])
        for k in ("first", "convs", "children", "leaves", "saved", "ends"):
            setattr(node, k, row[k])
        return node

    def add(self, other: Node) -> None:
        """The same node, seen elsewhere."""
        self.first = other.first if self.first is None else self.first if other.first is None else min(self.first, other.first)
        self.convs += other.convs
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def close(self, parent: Node | None) -> dict:
        """The ended node; its sums go to the parent."""
        leaves = self.leaves if self.children else 1
        total = self.saved + (self.convs - 1) * self.bytes
        if parent is not None:
            parent.children += 1
            parent.leaves += leaves
            parent.saved += total
            parent.convs += self.convs
            parent.first = self.first if parent.first is None or self.first is not None and self.first < parent.first else parent.first
        return {"kind": 0, "name": self.name, "parent": parent.name if parent else None, "conv_id": self.first, "depth": self.depth, "n_convs": self.convs, "n_children": self.children, "n_leaves": leaves, "saved_tokens": total, "ends": self.ends}


ROOT = b""
NODE_TYPE = pa.struct([("bytes", pa.int64()), ("children", pa.int64()), ("convs", pa.int64()), ("depth", pa.int64()), ("ends", pa.string()), ("first", pa.int64()), ("leaves", pa.int64()), ("name", pa.binary()), ("saved", pa.int64())])
SWEPT = pa.schema([("kind", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("place", pa.int32()), ("left", pa.list_(NODE_TYPE)), ("right", pa.list_(NODE_TYPE))])
_NODE = "struct<bytes: long, children: long, convs: long, depth: long, ends: string, first: long, leaves: long, name: binary, saved: long>"
SWEPT_SQL = f"kind int, name binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, place int, left array<{_NODE}>, right array<{_NODE}>"


def _lcp(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _batched(rows: Iterator[dict], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=SWEPT)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=SWEPT)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range of (place, conv_id, turns): its ended nodes (kind 0), then its open stacks (kind 1).

    left has the nodes of the first array that ended here, right those of the last array's path. Nodes on both paths are
    in right only; their depths begin at 0, the others' behind the prefix that both arrays have in common.
    """

    def rows() -> Iterator[dict]:
        path: list[bytes] = []
        stack: list[Node] = []
        left: list[Node] = []
        kept = 0  # nodes of the stack that lie on the first array's path: up to this depth
        sha, ended, place = None, None, 0

        def finish() -> None:
            nonlocal sha, ended
            if ended is not None:
                ended.ends = sha.hexdigest()
                sha = ended = None

        def down_to(depth: int) -> Iterator[dict]:
            nonlocal kept
            while len(stack) > depth + 1:
                node = stack.pop()
                if node.depth <= kept:
                    kept = node.depth - 1
                    left.append(node)  # may have begun before: whoever closes it adds it to its parent
                else:
                    yield node.close(stack[-1])

        for batch in batches:
            for at, conv, turns in zip(*(batch.column(c).to_pylist() for c in ("place", "conv_id", "turns")), strict=True):
                now = [t["digest"] for t in turns]
                if not stack:
                    place, kept = at, len(now)
                    stack.append(Node(0, ROOT, 0))
                    shared = 0
                else:
                    shared = _lcp(path, now)
                    if shared < len(path) or shared < len(now):
                        finish()
                    yield from down_to(shared)
                for d in range(shared, len(now)):
                    stack.append(Node(d + 1, hashlib.md5(stack[-1].name + now[d]).digest(), turns[d]["size"]))
                node = stack[-1]
                if sha is None:
                    sha, ended = hashlib.sha256(str(conv).encode()), node
                else:
                    sha.update(b"," + str(conv).encode())
                node.convs += 1
                node.first = conv if node.first is None else min(node.first, conv)
                path = now
        finish()
        if stack:
            yield {"kind": 1, "place": place, "left": [n.pack() for n in reversed(left)], "right": [n.pack() for n in stack]}

    return _batched(rows())


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ended nodes of the open stacks of all ranges in turn (kind 0), and nodes whose ends lie in several ranges (kind 2)."""

    def rows() -> Iterator[dict]:
        stack: list[Node] = []
        split: set[bytes] = set()
        for batch in batches:
            for r in batch.to_pylist():
                right = [Node.unpack(x) for x in r["right"]]
                both = [Node.unpack(x) for x in r["left"]]
                common = both[0].depth if both else len(right)  # depths below are on both paths, or all are
                first = right[:common] + both
                shared = 0
                while shared < min(len(stack), len(first)) and stack[shared].name == first[shared].name:
                    shared += 1
                while len(stack) > shared:
                    node = stack.pop()
                    yield node.close(stack[-1] if stack else None)
                for k, node in enumerate(first):
                    if k < shared:
                        if stack[k].ends and node.ends:
                            split.add(node.name)
                        stack[k].add(node)
                    else:
                        stack.append(node)
                while both and len(stack) > common:
                    node = stack.pop()
                    yield node.close(stack[-1])
                stack.extend(right[common:])
        while stack:
            node = stack.pop()
            yield node.close(stack[-1] if stack else None)
        for name in sorted(split):
            yield {"kind": 2, "name": name}

    return _batched(rows())


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, digest of the members in order of (name, conv_id), rows of a name standing together."""
    at, sha = None, None
    for batch in batches:
        out = []
        for name, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if name != at:
                if sha is not None:
                    out.append((at, sha.hexdigest()))
                at, sha = name, hashlib.sha256(str(conv).encode())
            else:
                sha.update(b"," + str(conv).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["name", "whole"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["name", "whole"])


def _node_name(turns: str) -> str:
    return f"aggregate({turns}, cast('' as binary), (n, t) -> unhex(md5(concat(n, t.digest))))"


def trie(convs: DataFrame, per_range: int = PER_RANGE, ranges: int = RANGES) -> DataFrame:
    """Nodes of the conversations (saved; conv_id, each once, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    n = convs.count()
    parts = max(ranges, -(-n // per_range))
    key = F.transform("turns", lambda t: t["digest"])
    dealt = convs.select("conv_id", "turns", key.alias("key")).repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = saved(dealt.select(F.spark_partition_id().alias("place"), "conv_id", "turns").mapInArrow(sweep, SWEPT_SQL))
    stacks = swept.where("kind = 1").coalesce(1).sortWithinPartitions("place")
    stitched = saved(stacks.mapInArrow(stitch, SWEPT_SQL))
    nodes = swept.where("kind = 0").unionByName(stitched.where("kind = 0"))
    split = stitched.where("kind = 2").select("name")
    if not split.isEmpty():  # at most one for each range
        named = convs.select("conv_id", F.expr(_node_name("turns")).alias("name")).join(F.broadcast(split), "name")
        whole = named.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_ends, "name binary, whole string")
        nodes = nodes.join(F.broadcast(saved(whole)), "name", "left").withColumn("ends", F.coalesce("whole", "ends")).drop("whole")
    out = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")]
    inner = saved(nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight")))
    below = looked_up(nodes.where("parent is not null"), inner, ["parent"], "weight", F.xxhash64("name"))
    top = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    both = below.select(*out, "parent_conv_id").unionByName(top.select(*out, "parent_conv_id"))
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    convs = saved(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    head = F.expr("crc32(cast(cast(conv_id as string) as binary)) % 9")
    return trie(saved(grafted(convs, F.expr("conv_id - conv_id % 5"), head)))


_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)"
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS p, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.r, t.x FROM c JOIN t ON t.conv_id = c.p AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
k AS (SELECT conv_id, list(md5(concat(strlen(r), ':', r, x)) ORDER BY own, pos) AS ks, list(strlen(x) ORDER BY own, pos) AS bs FROM b GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(ks, []) AS ks, coalesce(bs, []) AS bs FROM c LEFT JOIN k USING (conv_id)),
m AS (SELECT conv_id, unnest(range(len(ks) + 1)) AS d, ks, bs FROM a),
m2 AS (SELECT conv_id, d, d = len(ks) AS last, md5(array_to_string(ks[1:d], ',')) AS name, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS size FROM m),
n AS (SELECT d, name, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
      FROM m2 GROUP BY d, name),
ch AS (SELECT d - 1 AS d, parent AS name, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
n2 AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, name)),
up AS (SELECT a.d, a.name, sum(n2.own) AS saved_tokens, sum(CASE WHEN n2.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
       FROM n2 JOIN m2 a ON a.conv_id = n2.conv_id AND a.d <= n2.d GROUP BY a.d, a.name)
SELECT n2.conv_id, n2.d AS depth, q.conv_id AS parent_conv_id, n2.n_convs, n2.n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, n2.ends_sha256
FROM n2 JOIN up USING (d, name) LEFT JOIN n2 q ON q.d = n2.d - 1 AND q.name = n2.parent
"""
