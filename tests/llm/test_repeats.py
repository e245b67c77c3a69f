"""Suffix dedup against dictionaries of all passages; the suffix order against sorted()."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, registry, repeats, suffixes

LAST = (1 << 63) - 1


def plain(docs, length=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, LAST), LAST if d is None else d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (LAST if d is None else d):
                gone[max(i, end) : i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def planted(seed=0, n=150):
    rng = random.Random(seed)
    chars = "abcdefgh éß\n\0\U0001f600"
    text = lambda k: "".join(rng.choice(chars) for _ in range(k))
    passages = [text(rng.choice([30, 45, 50, 51, 60, 90, 400])) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(80)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(6))]
        docs.append((i, "".join(parts)))
    copy = text(700)
    docs += [(1000 + i, copy) for i in range(40)]  # exact copies, near copies
    docs += [(2000 + i, copy[: i * 9] + "X" + copy[i * 9 + 1 :]) for i in range(40)]
    docs += [(3000, "ab" * 900), (3001, "ab" * 800), (3002, "a" * 3000), (3003, "=" * 49), (3004, "=" * 50), (3005, "=" * 51)]
    docs += [(None, copy), (None, text(20) + passages[-1]), (5000, None), (5001, ""), (1, docs[0][1]), (1000, copy), (1000, "other " + copy)]
    rng.shuffle(docs)
    return docs


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("repeats"))
    docs = planted()
    spark.createDataFrame([(*x, i, "x") for i, x in enumerate(docs)], "doc_id long, text string, d int, places string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d, docs


def test_query_against_all_passages(spark, folder):
    got, want = found(registry.QUERIES["op11_suffix_dedup"](spark, folder[0])), plain(folder[1])
    assert got == want and sum(w[2] > 0 for w in want) > 80


def test_short_pieces_and_small_buckets(spark, folder, monkeypatch):
    """Texts in pieces, runs cut, buckets one anchor each, large ones by digests of passages, frequent ones spread."""
    monkeypatch.setattr(repeats, "SLICE", 300)
    monkeypatch.setattr(repeats, "RUN", 7)
    monkeypatch.setattr(repeats, "BUCKET", 400)
    monkeypatch.setattr(repeats, "PACK", 50)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 0)
    monkeypatch.setattr(common, "is_small", lambda *_: False)
    assert found(registry.QUERIES["op11_suffix_dedup"](spark, folder[0])) == plain(folder[1])


def test_crowded_anchors_are_split(spark, folder, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 16)
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert len(repeats._crowded(repeats._keyed(docs), 50, docs.count())) > 5
    assert found(registry.QUERIES["op11_suffix_dedup"](spark, folder[0])) == plain(folder[1])


def test_other_lengths_and_texts(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for length in (24, 120):
        want = {(d, b): r for (d, b, r, *_) in plain(folder[1], length)}
        places = repeats.with_places(docs, repeats.covered(docs, length), "_at")
        for r in places.collect():
            at = repeats._stretches(r._at)
            assert int((at[:, 1] - at[:, 0]).sum()) == want[(r.doc_id, len((r.text or "").encode()))]
    out = repeats.without_repeats(docs, repeats.covered(docs))
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("text is null").count() == 1
    with pytest.raises(ValueError):
        repeats.covered(docs, 20)


def test_long_text(spark, tmp_path):
    """A text of 10 MB, and half of it in another document, in bounded time."""
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 10_000_000, np.uint8).tobytes().decode()
    spark.createDataFrame([(1, text), (2, "X" + text[3_000_000:8_000_000] + "Y"), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in registry.QUERIES["op11_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0), 2: (5_000_000, 1), 3: (0, 0)}


@pytest.mark.parametrize("v", sorted(suffixes.COVERS))
def test_suffix_order(v):
    rng = random.Random(v)
    assert suffixes.shifts(v).max() < v
    for trial in range(60):
        letters = "ab\0" if trial % 2 else "abcdefgh"
        strings = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))).encode() for _ in range(rng.randrange(8))]
        strings += strings[:2] + [b"a" * rng.randrange(300)]
        sizes = np.array([len(s) for s in strings])
        text, ends = np.frombuffer(b"".join(strings), np.uint8), np.repeat(np.cumsum(sizes), sizes)
        want = sorted(range(len(text)), key=lambda p: (bytes(text[p : ends[p]]), p))
        got = [p for b in suffixes.buckets(text, ends, np.arange(len(text)), v, rng.randrange(1, 50)) for p in b.tolist()]
        assert got == want


def test_empty_and_short(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.covered(empty).count() == 0
    few = spark.createDataFrame([(1, "a" * 50), (2, "a" * 50), (3, "a" * 49), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, repeats._stretches(r.places).tolist()) for r in repeats.covered(few).collect()] == [(2, [[0, 50]])]
    assert repeats.without_repeats(few, repeats.covered(few)).where(F.length("text") == 0).count() == 1


@pytest.mark.parametrize("seed", range(40))
def test_passages_of_several_documents(seed):
    """What bounded prefix doubling leaves, and the classes, against dictionaries of passages; few letters, so that many are shared."""
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 90, rng.integers(1, 12))
    text = rng.integers(97, 97 + rng.integers(1, 4), int(size.sum())).astype(np.uint8)
    text = np.resize(text[:7], len(text)) if seed % 3 == 0 and len(text) else text
    ends, d = np.repeat(np.cumsum(size), size), np.repeat(np.sort(rng.integers(0, 6, len(size))), size)
    for length in (8, 13, 24, 50):
        held: dict[bytes, list[int]] = {}
        for p in range(len(text)):
            if ends[p] - p >= length:
                held.setdefault(text[p : p + length].tobytes(), []).append(p)
        shared = {w: ps for w, ps in held.items() if len({d[p] for p in ps}) > 1}
        at, group = suffixes.repeated(text, ends, d, length)
        assert [sorted(at[group == g].tolist()) for g in range(len(shared))] == [shared[w] for w in sorted(shared)]
        assert repeats.classes(text, ends, d, length).tolist() == sorted(p for ps in shared.values() for p in ps if d[p] > min(d[q] for q in ps))
