"""FLAC in numpy: many frames at once. Decodes streams of 1 to 8 channels and 4 to 24 bits: Rice, escaped, fixed, linear
prediction, constant and verbatim subframes, wasted bits, side channels. Encodes 8-bit mono by fixed predictors.

Work goes by CHUNK frames at a time, so that memory beside the stream and its samples is bounded.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np

BLOCK, RATE, PARTITIONS = 576, 8000, 2
#: Frames that are encoded or decoded at a time.
CHUNK = 2048
U = np.uint64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return np.array(out, np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_LEADING = np.array([16] + [16 - x.bit_length() for x in range(1, 1 << 16)], np.uint8)


def _crc(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each stretch of buf, all in step; the longest come first, so that those still running are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    at, n, crc = starts[order], lengths[order], np.zeros(len(order), np.uint32)
    running = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right") if len(n) else []
    for i, k in enumerate(running):
        b = buf[at[:k] + i]
        crc[:k] = _CRC8[crc[:k] ^ b] if bits == 8 else ((crc[:k] << 8) & 0xFFFF) ^ _CRC16[(crc[:k] >> 8) ^ b]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *reversed(tail)])


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit samples, a block a row, to (bytes of all frames in turn, where each begins and the last ends)."""
    f, n = x.shape
    diffs = [x]
    for _ in range(4):
        diffs.append(np.diff(diffs[-1], axis=1))
    cost = np.stack([np.abs(d[:, 4 - o :]).sum(axis=1) for o, d in enumerate(diffs)])
    order = cost.argmin(axis=0)
    u = np.zeros((f, n), np.int64)
    for o in range(5):
        at = order == o
        u[at, o:] = diffs[o][at]
    u = np.where(u >= 0, 2 * u, -2 * u - 1)
    part = n >> PARTITIONS
    coded = np.arange(n)[None, :] >= order[:, None]
    sums = np.stack([np.where(coded, u >> k, 0).reshape(f, -1, part).sum(axis=2) + (k + 1) * part for k in range(8)])
    k = sums.argmin(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    bits = sums.min(axis=0).sum(axis=1) + 8 * order
    verbatim = ~constant & (bits + 10 + (4 << PARTITIONS) >= 8 * n)
    kt = np.repeat(k, part, axis=1)
    q = u >> kt
    raw = np.where(constant, 1, np.where(verbatim, n, order))
    coded = (np.arange(n)[None, :] >= raw[:, None]) & ~constant[:, None]
    literal = np.arange(n)[None, :] < raw[:, None]
    size = np.where(literal, 8, np.where(coded, q + 1 + kt, 0))
    head = [bytes([0xFF, 0xF8, 0x20, 0x02]) + _number(int(i)) for i in numbers]
    hn = np.array([len(h) + 1 for h in head])
    residual = ~constant & ~verbatim
    lead = np.where(residual[:, None] & (np.arange(n)[None, :] >= raw[:, None]), 6 + 4 * (np.arange(n) // part + 1)[None, :], 0)
    pos = 8 + np.cumsum(size, axis=1) - size + lead
    total = 8 + size.sum(axis=1) + np.where(residual, 6 + (4 << PARTITIONS), 0)
    length = hn + (total + 7) // 8 + 2
    ends = np.concatenate([[0], np.cumsum(length)])
    base = 8 * (ends[:-1] + hn)
    out = np.zeros(8 * ends[-1], np.uint8)

    def put(at, value, width):
        for j in range(width):
            out[at + j] = (value >> (width - 1 - j)) & 1

    put(base, np.where(constant, 0, np.where(verbatim, 1, 8 + order)) << 1, 8)
    pos = pos + base[:, None]
    put(pos[literal], x[literal] & 0xFF, 8)
    at, qc, kc, uc = pos[coded], q[coded], kt[coded], u[coded]
    out[at + qc] = 1
    for j in range(int(kc.max(initial=0))):
        on = kc > j
        out[(at + qc + kc - j)[on]] = (uc[on] >> j) & 1
    if residual.any():
        rows = np.flatnonzero(residual)
        put(base[rows] + 8 + 8 * order[rows], np.full(len(rows), PARTITIONS), 6)
        for p in range(1 << PARTITIONS):
            t = np.maximum(p * part, order[rows])
            put(pos[rows, t] - 4, k[rows, p], 4)
    out = np.packbits(out)
    heads = np.frombuffer(b"".join(h + b"\0" for h in head), np.uint8)
    off = np.concatenate([[0], np.cumsum(hn)])
    within = np.arange(off[-1]) - np.repeat(off[:-1], hn)
    out[np.repeat(ends[:-1], hn) + within] = heads
    out[ends[:-1] + hn - 1] = _crc(out, ends[:-1], hn - 1, 8)
    crc = _crc(out, ends[:-1], length - 2, 16)
    out[ends[1:] - 2], out[ends[1:] - 1] = crc >> 8, crc & 0xFF
    return out, ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """8-bit mono streams of payloads whose lengths are multiples of BLOCK; byte b is the sample b - 128. A seek point for every frame."""
    counts = [len(p) // BLOCK for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, np.int64)
    done = [_frames(x[i : i + CHUNK].astype(np.int64) - 128, numbers[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
    data = b"".join(d.tobytes() for d, _ in done)
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in done]))]) if done else np.zeros(1, np.int64)
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = ends[at : at + c + 1]
        sizes = np.diff(own)
        samples = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        seek = np.empty(c, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        seek["sample"], seek["offset"], seek["n"] = np.arange(c) * BLOCK, own[:-1] - own[0], BLOCK
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * c).to_bytes(3, "big") + seek.tobytes() + data[own[0] : own[-1]])
        at += c
    return out


def header(media: bytes) -> dict:
    """Stream information, seek points and where the frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, out = 4, {"seek": np.empty((0, 3), np.int64)}
    while True:
        kind, n = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            out |= {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "samples": x & (1 << 36) - 1, "md5": body[18:34], "largest": int.from_bytes(body[7:10], "big")}
        elif kind == 3:
            s = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            s = s[s["sample"] != 0xFFFFFFFFFFFFFFFF]
            out["seek"] = np.stack([s["sample"], s["offset"], s["n"]], axis=1).astype(np.int64)
        last, at = media[at] >> 7, at + 4 + n
        if last:
            return out | {"frames": at}


class _Bits:
    def __init__(self, buf: np.ndarray):
        self.buf = buf
        b = np.concatenate([buf, np.zeros(16, np.uint8)])
        n = len(b) - 8
        self.words = np.zeros(n, U)
        for i in range(8):
            self.words |= b[i : n + i].astype(U) << U(56 - 8 * i)

    def window(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from pos on, at the top."""
        return self.words[pos >> 3] << (pos & 7).astype(U)

    def read(self, pos: np.ndarray, width) -> np.ndarray:
        width = np.asarray(width)
        return np.where(width > 0, ((self.window(pos) >> U(1)) >> (63 - width).astype(U)).astype(np.int64), 0)

    def signed(self, pos: np.ndarray, width) -> np.ndarray:
        x, width = self.read(pos, width), np.asarray(width, np.int64)
        return np.where((width > 0) & (x >> np.maximum(width - 1, 0) == 1), x - (1 << width), x)

    def rice(self, pos: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unsigned values, positions after them)."""
        w = self.window(pos)
        q = _LEADING[(w >> U(48)).astype(np.int64)].astype(np.int64)
        if (q == 16).any():
            more = np.flatnonzero(q == 16)
            while len(more):
                add = _LEADING[(self.window(pos[more] + q[more]) >> U(48)).astype(np.int64)].astype(np.int64)
                q[more] += add
                more = more[(add == 16) & (pos[more] + q[more] < 8 * len(self.buf))]
            w = self.window(pos + q) << U(1)
        else:
            w = w << (q + 1).astype(U)
        low = ((w >> U(1)) >> (63 - k).astype(U)).astype(np.int64)
        return (q << k) | low, pos + q + 1 + k


def decode_frames(buf: np.ndarray, starts: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(samples of each frame, channels interleaved, where each frame ends); raises ValueError where a checksum or a field is wrong."""
    try:
        return _decode_frames(buf, starts, bits)
    except IndexError as e:
        raise ValueError("a frame runs past the end of its stream") from e


def _decode_frames(buf: np.ndarray, starts: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    r = _Bits(buf)
    b = np.concatenate([buf, np.zeros(32, np.uint8)]).astype(np.int64)
    if not ((b[starts] == 0xFF) & (b[starts + 1] & 0xFE == 0xF8)).all():
        raise ValueError("no frame where one should begin")
    code, rate = b[starts + 2] >> 4, b[starts + 2] & 15
    layout = b[starts + 3] >> 4
    width = np.select([(b[starts + 3] >> 1 & 7) == i for i in (0, 1, 2, 4, 5, 6)], [bits, 8, 12, 16, 20, 24], -1)
    if (layout > 10).any() or (width < 0).any() or ((rate == 15) | (code == 0)).any():
        raise ValueError("a frame of a reserved kind")
    channels = np.where(layout < 8, layout + 1, 2)
    lead = b[starts + 4]
    utf = np.where(lead < 0x80, 1, _LEADING[((~lead & 0xFF) << 8)].astype(np.int64))
    at = starts + 4 + utf
    blocks = np.select([code == 1, code < 6, code == 6, code == 7], [192, 576 << np.maximum(code - 2, 0), b[at] + 1, (b[at] << 8 | b[at + 1]) + 1], 256 << np.maximum(code - 8, 0))
    at = at + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (_crc(b.astype(np.uint8), starts, at - starts, 8) != b[at]).any():
        raise ValueError("a frame header's checksum is wrong")
    pos = 8 * (at + 1)
    found: list[list[np.ndarray]] = [[] for _ in starts]
    for c in range(int(channels.max(initial=0))):
        side = ((layout == 8) | (layout == 10)) & (c == 1) | (layout == 9) & (c == 0)
        rows = np.flatnonzero(channels > c)
        samples, pos[rows] = _subframes(r, pos[rows], blocks[rows], (width + side)[rows])
        for row, x in zip(rows, samples, strict=True):
            found[row].append(x)
    out = [_joined(xs, int(how)) for xs, how in zip(found, layout, strict=True)]
    ends = (pos + 7) // 8
    crc = _crc(b.astype(np.uint8), starts, ends - starts, 16)
    if (crc != (b[ends] << 8 | b[ends + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return out, ends + 2


def _joined(channels: list[np.ndarray], layout: int) -> np.ndarray:
    """Samples of a frame, channels interleaved; undoes left/side, side/right and mid/side."""
    if len(channels) == 1:
        return channels[0]
    if layout >= 8:
        x, y = channels
        if layout == 8:
            channels = [x, x - y]
        elif layout == 9:
            channels = [x + y, y]
        else:
            mid = (x << 1) | (y & 1)
            channels = [(mid + y) >> 1, (mid - y) >> 1]
    return np.stack(channels, axis=1).reshape(-1)


def _subframes(r: _Bits, pos: np.ndarray, blocks: np.ndarray, width: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(samples, position after it) of a subframe of each frame."""
    head = r.read(pos, 8)
    if (head & 0x80).any():
        raise ValueError("no subframe where one should begin")
    kind, pos = head >> 1, pos + 8
    wasted = np.zeros(len(pos), np.int64)
    if (some := np.flatnonzero(head & 1)).size:
        wasted[some] = 1 + _LEADING[(r.window(pos[some]) >> U(48)).astype(np.int64)]
        pos[some] += wasted[some]
        width = width - wasted
        if (width <= 0).any():
            raise ValueError("more wasted bits than a sample has")
    out: list = [None] * len(pos)
    for t, n, w in {*zip(kind.tolist(), blocks.tolist(), width.tolist(), strict=True)}:
        rows = np.flatnonzero((kind == t) & (blocks == n) & (width == w))
        p = pos[rows]
        if t == 0:
            x = np.repeat(r.signed(p, w)[:, None], n, axis=1)
            p = p + w
        elif t == 1:
            x = r.signed(p[:, None] + w * np.arange(n), w)
            p = p + w * n
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            warm = r.signed(p[:, None] + w * np.arange(order), w)
            p = p + w * order
            coef = shift = None
            if t >= 32:
                precision, shift = r.read(p, 4) + 1, r.signed(p + 4, 5)
                coef = r.signed(p[:, None] + 9 + precision[:, None] * np.arange(order), precision[:, None])
                p = p + 9 + precision * order
            x, p = _residual(r, p, n, order)
            x = _fixed(x, warm) if coef is None else _linear(x, warm, coef, shift)
        else:
            raise ValueError("a reserved kind of subframe")
        pos[rows] = p
        for i, row in enumerate(rows):
            out[row] = x[i] << wasted[row]
    return out, pos


def _residual(r: _Bits, pos: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    method, parts = r.read(pos, 2), r.read(pos + 2, 4)
    if (method > 1).any():
        raise ValueError("a reserved kind of residual")
    pos = pos + 6
    out = np.zeros((len(pos), n - order), np.int64)
    for m, s in {*zip(method.tolist(), parts.tolist(), strict=True)}:
        rows = np.flatnonzero((method == m) & (parts == s))
        p, width, each = pos[rows], 4 + m, n >> s
        if each << s != n or each < order:
            raise ValueError("a residual's partitions don't fit its block")
        u = np.zeros((len(rows), n), np.int64)
        for part in range(1 << s):
            k = r.read(p, width)
            p = p + width
            raw = k == (1 << width) - 1
            raws = np.where(raw, r.read(p, 5), 0)
            p, k = p + 5 * raw, np.where(raw, 0, k)
            escaped = raw.any()
            for t in range(max(order, part * each), (part + 1) * each):
                if escaped:
                    plain = r.signed(p, raws)
                    v, after = r.rice(p, k)
                    u[:, t] = np.where(raw, np.where(plain >= 0, 2 * plain, -2 * plain - 1), v)
                    p = np.where(raw, p + raws, after)
                else:
                    u[:, t], p = r.rice(p, k)
        u = u[:, order:]
        out[rows] = (u >> 1) ^ -(u & 1)
        pos[rows] = p
    return out, pos


def _fixed(x: np.ndarray, warm: np.ndarray) -> np.ndarray:
    """Residuals are differences of the warm-up's order: sum them up as often."""
    for j in range(warm.shape[1] - 1, -1, -1):
        x = np.diff(warm, n=j, axis=1)[:, -1:] + np.cumsum(x, axis=1)
    return np.concatenate([warm, x], axis=1)


def _linear(x: np.ndarray, warm: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = warm.shape[1]
    out = np.concatenate([warm, x], axis=1)
    back = coef[:, ::-1]
    for t in range(order, out.shape[1]):
        out[:, t] += (out[:, t - order : t] * back).sum(axis=1) >> shift
    return out


def _bare_frames(media: bytes, h: dict) -> Iterator[np.ndarray]:
    """Samples of the frames of a stream without (all) seek points, found one by one in a window that grows where a frame doesn't fit."""
    buf, at = np.frombuffer(media, np.uint8), h["frames"]
    window = h["largest"] + 16 if h["largest"] else 1 << 14
    while at < len(buf):
        try:
            x, end = decode_frames(buf[at : at + window], np.zeros(1, np.int64), h["bits"])
        except ValueError:
            if at + window >= len(buf):
                raise
            window *= 2
            continue
        yield x[0]
        at += int(end[0])


def segments(medias: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number of the stream, sample offset, samples) in turn, of at most CHUNK frames; verifies every checksum and, with a stream's last samples, its MD5."""
    heads = [header(m) for m in medias]
    sums = [hashlib.md5() for _ in medias]
    ready = [0] * len(medias)

    def passed(i: int, x: np.ndarray) -> tuple[int, int, np.ndarray]:
        width = (heads[i]["bits"] + 7) // 8
        sums[i].update(x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
        offset = ready[i]
        ready[i] += len(x) // heads[i]["channels"]
        return i, offset, x.astype(np.int32)

    def ended(i: int) -> None:
        if any(heads[i]["md5"]) and sums[i].digest() != heads[i]["md5"]:
            raise ValueError("the samples' MD5 is wrong")

    def seekable(run: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        which = np.repeat(run, [len(heads[i]["seek"]) for i in run])
        first = np.concatenate([heads[i]["frames"] + heads[i]["seek"][:, 1] for i in run])
        last = np.append(which[1:] != which[:-1], True)
        after = np.where(last, np.array([len(medias[i]) for i in which]), np.roll(first, -1))
        for s in range(0, len(which), CHUNK):
            own = which[s : s + CHUNK]
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            parts, starts, base = [], [], 0
            for a, b in zip(edges, edges[1:], strict=False):
                low, high = int(first[s + a]), int(after[s + b - 1])
                parts.append(np.frombuffer(medias[own[a]], np.uint8)[low:high])
                starts.append(first[s + a : s + b] - low + base)
                base += high - low
            found, _ = decode_frames(np.concatenate(parts), np.concatenate(starts), heads[own[0]]["bits"])
            for a, b in zip(edges, edges[1:], strict=False):
                yield passed(int(own[a]), np.concatenate(found[a:b]))
                if last[s + b - 1]:
                    ended(int(own[a]))

    complete = [len(h["seek"]) > 0 and h["seek"][:, 2].sum() == h["samples"] for h in heads]
    i = 0
    while i < len(medias):
        if not complete[i]:
            for x in _bare_frames(medias[i], heads[i]):
                yield passed(i, x)
            ended(i)
            i += 1
            continue
        run = [i]
        while run[-1] + 1 < len(medias) and complete[run[-1] + 1] and heads[run[-1] + 1]["bits"] == heads[i]["bits"]:
            run.append(run[-1] + 1)
        yield from seekable(run)
        i = run[-1] + 1


def decode(medias: list[bytes]) -> list[np.ndarray]:
    """Samples of whole streams, channels interleaved; verifies every checksum and the MD5."""
    out: list[list[np.ndarray]] = [[] for _ in medias]
    for i, _, x in segments(medias):
        out[i].append(x)
    return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]


def read(media: bytes, start: int, n: int) -> np.ndarray:
    """n samples (of each channel) from sample start on, decoding only the frames that hold them."""
    h = header(media)
    points = h["seek"]
    first, last = (int(np.searchsorted(points[:, 0], s, side="right")) - 1 for s in (start, start + n - 1))
    parts, _ = decode_frames(np.frombuffer(media, np.uint8), h["frames"] + points[first : last + 1, 1], h["bits"])
    x, c = np.concatenate(parts), h["channels"]
    return x[(start - points[first, 0]) * c :][: n * c]
