"""Spelling variants against a version in plain Python that tries every deletion."""

import collections
import random
import re
import zlib

import pytest

from quillspark.llm import registry, spelling


def words_of(docs):
    count = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain(n_of, factor=10):
    near = {w: set() for w in n_of}
    shorter = collections.defaultdict(set)
    for w in n_of:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
    for k, group in shorter.items():
        for a in group:
            if k in n_of:
                near[a].add(k)
                near[k].add(a)
            near[a] |= {b for b in group if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-n_of[x], x))
            if n_of[best] >= factor * n_of[w]:
                form[w] = best
    out = {}
    for w in n_of:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n_of[w], len(near[w]), n_of[form[w]] if w in form else None)
    return out


def rows_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def edited(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + word[i + 1 :] if kind == 0 else word[:i] + rng.choice(letters) + word[i + kind - 1 :]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    letters = "abcdeéèÿÀßxyz×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(40)]
    pool = [(w, 300) for w in base] + [(edited(rng, w, letters), 20) for w in base for _ in range(4)] + [(edited(rng, edited(rng, w, letters), letters), 2) for w in base for _ in range(6)]
    pool += [("aaaaaaa" + "b" * 3000, 3), ("aaaaaaa" + "b" * 3001, 40)]
    text = [w.upper() if rng.random() < 0.1 else w for w, n in pool for _ in range(n)]
    rng.shuffle(text)
    cut = [text[i : i + 50] for i in range(0, len(text), 50)]
    return [*((i, rng.choice([" ", "\n", "1", "-"]).join(x)) for i, x in enumerate(cut)), (None, " ".join(cut[0])), (0, " ".join(cut[0])), (7, None), (8, ""), (9, "ok ÿ short")]


def test_words_and_variants(spark, docs, tmp_path):
    n_of = words_of(docs)
    want = plain(n_of)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] != v[1] for v in want.values() if v[0])
    spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(registry.QUERIES["op13_spelling_variants"](spark, str(tmp_path))) == want


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_divided_groups(spark, docs, block, monkeypatch):
    """Groups of any size are cut in two ways without loss; groups are compared in step or in rectangles."""
    n_of = words_of(docs)
    words = spark.createDataFrame([(w, n) for w, n in n_of.items()], "word string, n long")
    monkeypatch.setattr(spelling, "CHUNK", 50)
    monkeypatch.setattr(spelling, "STEP", block % 7)
    assert rows_of(spelling.variants(words, block=block)) == plain(n_of)


def test_one_edit_flips_two_bits_at_most():
    rng = random.Random(1)
    letters = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
    bits = spelling.letter_bits()

    def mask(word):
        out = 0
        for c in word.encode("latin-1"):
            out ^= int(bits[c])
        return out

    for _ in range(2000):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 20)))
        assert bin(mask(word) ^ mask(edited(rng, word, letters))).count("1") <= 2
    assert max(int(b).bit_length() for b in bits) <= spelling.BANDS * spelling.BITS


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w3"), ("y", "z")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "z" if w == "y" else "w37" for w, _ in chain}
