"""FLAC, chat escapes, trigram queries, packing and budgets without Spark."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat, flac, jaccard, media, mixing, packing, secrets, toxicity


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=2000), min_size=1, max_size=4))
def test_flac_round_trip(parts):
    payloads = [p + b"\xff" * (-len(p) % 576 or (0 if p else 576)) for p in parts]
    for p, x in zip(payloads, flac.decode(flac.encode(payloads)), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p


def test_flac_seek_and_damage():
    payload = media.padded("aé" * 3000)[1]
    stream = flac.encode([payload])[0]
    assert (flac.read(stream, 700, 50) + 128).astype(np.uint8).tobytes() == payload[700:750]
    h = flac.header(stream)
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[h["frames"] :]  # without seek points
    assert (flac.decode([bare])[0] + 128).astype(np.uint8).tobytes() == payload
    for at in (-1, -30, h["frames"] + 2, h["frames"] + 90):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_linear_prediction():
    """A frame written by hand: order 2, coefficients 2 and -1, a plain ramp; residuals all 0."""
    bits = "".join(f"{x:08b}" for x in (0xFF, 0xF8, 0x70, 0x02, 0, 0, 15))  # block size 16 in 16 bits
    head = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    crc = int(flac._crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), 8)[0])
    body = "0100001" + "0" + f"{5:08b}{7:08b}" + f"{2:04b}" + "00000" + "010" + "111" + "00" + "0000" + "0000" + "1" * 14
    body += "0" * (-len(body) % 8)
    frame = head + bytes([crc]) + bytes(int(body[i : i + 8], 2) for i in range(0, len(body), 8))
    tail = int(flac._crc(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 16)[0])
    x, _ = flac.decode_frames(np.frombuffer(frame + tail.to_bytes(2, "big"), np.uint8), np.array([0]), 8)
    assert x[0].tolist() == list(range(5, 37, 2))


pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "a", "é", "\n", "|turn|>"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), pieces), max_size=50))
def test_spans(turns):
    out, spans, rewrites = chat.spans_of(turns)
    assert not rewrites and out == chat.template(turns)
    assert [chat.unescape(out[c:d]) for *_, c, d in spans] == [t for _, t in turns]


def test_rewriting_template():
    last_only = lambda ts: "".join(f"[{r}]{t if i == len(ts) - 1 else ''}" for i, (r, t) in enumerate(ts))
    for n in (2, 50):
        assert chat.spans_of([("user", "a"), ("assistant", "b")] * n, last_only)[2]


def test_template_that_rewrites_at_some_lengths():
    fifth = lambda ts: ("!" if len(ts) % 5 == 0 else "") + chat.template(ts)
    for n in (9, 31, 33, 64, 99):
        turns = [("user", f"t{i}") for i in range(n)]
        assert chat.spans_of(turns, fifth) == (fifth(turns), [], True)


@settings(max_examples=200, deadline=None)
@given(st.text("aAbkKtokensecretASIA019/+=-_.:'\" \n", max_size=40))
def test_trigram_queries_hold_where_rules_match(text):
    def holds(q):
        return q == secrets.ANY or (q[1] in low if q[0] == "has" else (all if q[0] == "and" else any)(map(holds, q[1])))

    low = text.encode().lower().decode()
    for p, flags in [(r.pattern, r.flags) for r in secrets.BASE + secrets.MORE] + [("(ab|ka)+t?o[ke]{2}n", 0), ("(?:sec|tok).*A{2,3}S", re.I)]:
        if re.search(p, text, flags):
            assert holds(secrets.trigram_query(p, flags))


def test_trigram_query_of_rules():
    assert secrets.trigram_query(r"[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", (("has", "aki"), ("has", "kia")))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), min_size=1, max_size=60))
def test_patterns(lengths):
    count = {x: lengths.count(x) for x in lengths}
    used: dict[int, int] = {}
    for n, parts in packing.patterns(count):
        assert n > 0 and sum(a * b for a, b in parts) <= 2048 and sum(b for a, b in parts if a > 682) <= 2
        for a, b in parts:
            used[a] = used.get(a, 0) + n * b
    assert used == count


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 5000])
def test_cut(n):
    parts = packing.cut(n)
    assert sum(b for _, b in parts) == n and all(b == 2048 for _, b in parts[1:]) and [a for a, _ in parts] == [sum(b for _, b in parts[:i]) for i in range(len(parts))]


def _tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))  # with its own settings


def test_token_ids_agree():
    t = _tokenizer()
    texts = ["", " ", "Hello  world\n\n x", "é😀日本", "a" * 500, "\t \r\n", "it's 12345 <|endoftext|>", "hello <|endoftext|> there", "<|endoftext|><|endoftext|>", "<|endoftext"]
    got = packing.encoder()(texts)
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert got[7] == [31373, 220, 50256, 612]


def test_token_ids_agree_on_all_code_points():
    """Both patterns see a code point as the same kind of character, beside letters, digits, marks and blanks."""
    t, encode = _tokenizer(), packing.encoder()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0x9F00 <= c < 0x20000 or c % 97 == 0)]
    for i in range(0, len(points), 20000):
        texts = [f"a{c}b1{c}2 {c}!{c}{c}'s  {c}" for c in points[i : i + 20000]]
        assert encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "'s", "'re", "<|endoftext|>", "é", "７", "\u00a0", "\u2028", "x" * 40, "12"]), max_size=14).map("".join)))
def test_token_ids_agree_on_any_text(text):
    assert _ENCODE([text])[0] == _TOKENIZER[0].encode(text, add_special_tokens=False).ids


try:
    _TOKENIZER, _ENCODE = [_tokenizer()], packing.encoder()
except BaseException:  # absent
    _TOKENIZER, _ENCODE = [], None


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), max_size=12), st.integers(0, 2000))
def test_fill(hist, budget):
    sizes, counts = np.array(list(hist), np.int64), np.array(list(hist.values()), np.int64)
    take = mixing.fill(sizes, counts, budget)
    assert ((0 <= take) & (take <= counts)).all() and (take * sizes).sum() <= max(0, budget)
    if sum(counts[sizes == 1]) >= 9 and budget < (sizes * counts).sum():
        assert budget - (take * sizes).sum() <= 60


def test_targets():
    t = mixing.targets({"a": 10, "b": 100, "c": 100, None: 100})
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(310) and t["b"] / t["c"] == pytest.approx(2) and t[None] == pytest.approx(t["b"] * 2.5)
    assert mixing.targets({}) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12), st.sampled_from([(17, 20), (4, 5)]))
def test_similar_sets_share_a_part_and_connect(lists, t):
    sets = sorted((np.unique(jaccard._mix(np.array(x, np.uint64))) for x in lists), key=len)
    parts = [set(jaccard.signatures(s, *t).tolist()) for s in sets]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.similar(sets[i], sets[j], *t):
                assert sets[i].tobytes() == sets[j].tobytes() or parts[i] & parts[j]
                root = [root[i] if r == root[j] else r for r in root]
    forest = jaccard.Forest(len(sets))
    for a, b in jaccard.tile_links(sets, *t):
        forest.join(a, b)
    same = lambda x: [[x[i] == x[j] for j in range(len(x))] for i in range(len(x))]
    assert same(list(forest.of)) == same(root)
    rough = jaccard.Forest(len(sets))
    for a, b in jaccard.group_forest(np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets], *t):
        rough.join(a, b)
    assert all(rough.of[i] == rough.of[j] for i in range(len(sets)) for j in range(len(sets)) if root[i] == root[j])


def test_toxicity_learns_unseen_spellings():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), 5))
    texts, labels = [], []
    for i in range(300):
        words = [word() for _ in range(30)]
        if i % 3 == 0:
            words[rng.integers(30)] = str(rng.choice(["stupid", "stupids", "stuupid", "horrible"]))
        texts.append(" ".join(words))
        labels.append(i % 3 == 0)
    m = toxicity.train(texts, np.array(labels))
    clean, bad = m.scores([" ".join(word() for _ in range(30)) + x for _ in range(20) for x in ("", " stupidd")]).reshape(-1, 2).T
    assert (clean < 0.5).mean() > 0.9 and (bad >= 0.5).mean() > 0.9
    assert m.scores(["", None]).tolist() == [0.0, 0.0]
    assert toxicity.train([], np.array([])).scores(["x"])[0] < 1e-9
