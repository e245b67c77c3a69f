"""The prefix trie against a version in plain Python over dictionaries of prefixes."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, registry, tries

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((-1, 0) if turn is None else (0, turn), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        long = rng.random() < 0.05
        for k in range(60 if long else rng.randrange(1, 6)):
            rows.append((c * rng.choice([1, 1, 1, 7]), k if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None]) if not long or k < 50 else "same"))
    rows += [(c, 0, "user", "one and the same") for c in range(1000, 1200)]  # a large group of copies
    rows += [(c, k, "user", "twice") for c in (2000, 2005, 2010, 2015) for k in range(30)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("trie"))
    rows = random_rows(0)
    spark.createDataFrame([(*r, "x", 1) for r in [*rows, (None, 0, "user", "nobody's"), rows[0]]], "conv_id long, turn long, role string, text string, name string, depth int").write.parquet(f"{d}/conversations.parquet")
    return d, [*rows, rows[0]]


def test_query_against_plain_python(spark, folder):
    assert found(registry.QUERIES["op12_prefix_trie"](spark, folder[0])) == plain(rebuilt(folder[1]))


@pytest.mark.parametrize("ranges", [1, 3, 40, 500])
def test_ranges_of_any_number(spark, ranges):
    """Paths that go through several ranges, equal arrays over several ranges, ranges without rows."""
    convs = rebuilt(random_rows(ranges))
    rows = spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    none = spark.createDataFrame([(c, []) for c, turns in convs.items() if not turns] + [(-3, [])], f"conv_id long, turns array<{tries.TURN}>")
    arrays = common.saved(tries.turn_arrays(rows).unionByName(none))
    assert found(tries.trie(arrays, per_range=1 << 16, ranges=ranges)) == plain({**convs, -3: []})


def test_hot_parents_are_spread(spark, folder, monkeypatch):
    monkeypatch.setattr(common, "is_small", lambda *_: False)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 0)
    assert found(registry.QUERIES["op12_prefix_trie"](spark, folder[0])) == plain(rebuilt(folder[1]))


def test_ties_of_turns_follow_role_and_text(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "x"), (1, None, "z", "z")]
    arrays = tries.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", F.size("turns").alias("n"), F.md5(F.col("turns")[1]["digest"]).alias("second"))
    assert arrays.first().n == 4 and arrays.first().second == hashlib.md5(hashlib.md5(b"1:ax").digest()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sql_gives_the_same(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder[0]}/conversations.parquet/*.parquet')")
    want = con.execute(registry.SQL["op12_prefix_trie"])
    names = [c[0] for c in want.description]
    assert sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in want.fetchall()), key=str) == plain(rebuilt(folder[1]))
