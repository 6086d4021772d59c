"""Lossless WebP images: all of the format is read; written are literal pixels with a prefix code for each channel."""

from __future__ import annotations

import heapq
import struct

import numpy as np


class WebpError(ValueError):
    pass


# Fixed values of the format: order of the lengths of code lengths, and places (x to the left, y up) of short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
PREDICTOR, COLOUR, GREEN, INDEXED = range(4)


class _Bits:
    """Bits of a stream, the lowest of each byte first. Beyond the end come zeros, a few at most."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        if self.at > len(self.data) + 16:
            raise WebpError("the image is cut off")
        self.held |= int.from_bytes(part, "little") << self.n
        self.at += 8
        self.n += 64

    def read(self, n: int) -> int:
        while self.n < n:
            self.fill()
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out

    def symbol(self, code: tuple[int, list[int]]) -> int:
        """Next symbol of a code: (bits of its longest word, word to symbol << 4 | length)."""
        most, table = code
        if self.n < most:
            self.fill()
        entry = table[self.held & ((1 << most) - 1)]
        self.held >>= entry & 15
        self.n -= entry & 15
        return entry >> 4


def _code(lengths: list[int]) -> tuple[int, list[int]]:
    """Table of the canonical prefix code with these lengths; a single symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        return 0, [0]
    if len(used) == 1:
        return 0, [used[0] << 4]
    most = max(lengths)
    table, word = [-1] * (1 << most), 0
    for n in range(1, most + 1):
        for s in used:
            if lengths[s] == n:
                if word >> n:
                    raise WebpError("a prefix code has too many words")
                first = int(f"{word:0{n}b}"[::-1], 2)
                table[first :: 1 << n] = [s << 4 | n] * (1 << most - n)
                word += 1
        word <<= 1
    if -1 in table:
        raise WebpError("a prefix code is incomplete")
    return most, table


def _read_code(bits: _Bits, size: int) -> tuple[int, list[int]]:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise WebpError("a symbol is beyond its alphabet")
            lengths[s] = 1
        return _code(lengths)
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    code = _code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        times = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + times > size:
            raise WebpError("code lengths run over")
        if s == 16:
            lengths[at : at + times] = [last] * times
        at += times
    return _code(lengths)


def _extended(bits: _Bits, prefix: int) -> int:
    """Number of a length's or distance's prefix and the bits after it."""
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + bits.read(extra) + 1


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> list[int]:
    """Pixels (alpha, red, green, blue from the highest byte down) of an image with its codes before it."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    step, group_of = 0, [0]
    if main and bits.read(1):
        step = bits.read(3) + 2
        wide = -(-width >> step)
        group_of = [p >> 8 & 0xFFFF for p in _pixels(bits, -(-width // (1 << step)), -(-height // (1 << step)), False)]
    wide = -(-width // (1 << step)) if step else 1
    groups = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(max(group_of) + 1)]
    total, out = width * height, []
    add, symbol = out.append, bits.symbol
    shift = 32 - cache_bits
    cached = 0  # pixels that are in the cache
    green, red, blue, alpha, far = groups[group_of[0]]
    while (n := len(out)) < total:
        if step:
            green, red, blue, alpha, far = groups[group_of[(n // width >> step) * wide + (n % width >> step)]]
        s = symbol(green)
        if s < 256:
            r = symbol(red)
            b = symbol(blue)
            add(symbol(alpha) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length, d = _extended(bits, s - 256), _extended(bits, symbol(far))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > n or n + length > total:
                raise WebpError("a copy lies outside the image")
            if d >= length:
                out += out[n - d : n - d + length]
            else:
                part = out[n - d :]
                out += (part * (length // d + 1))[:length]
        else:
            for p in out[cached:]:
                cache[(p * HASH & 0xFFFFFFFF) >> shift] = p
            cached = n
            add(cache[s - 280])
    return out


def _predicted(pixels: np.ndarray, modes: np.ndarray, step: int) -> None:
    """Undo the prediction of pixels (height, width, 4) in place; modes are of blocks of 1 << step pixels."""
    height, width, _ = pixels.shape
    rows = pixels.astype(np.int64)
    rows[0, 0, 3] += 255
    rows[0] = np.cumsum(rows[0], 0) & 255
    above = rows[0].tolist()
    out = [above]
    mode_of = modes.tolist()
    for y in range(1, height):
        line, row = rows[y].tolist(), []
        left = [(a + b) & 255 for a, b in zip(line[0], above[0], strict=True)]
        row.append(left)
        kinds = mode_of[y >> step]
        for x in range(1, width):
            t, tl = above[x], above[x - 1]
            tr = above[x + 1] if x + 1 < width else row[0]
            kind = kinds[x >> step]
            if kind == 1:
                p = left
            elif kind == 2:
                p = t
            elif kind == 3:
                p = tr
            elif kind == 4:
                p = tl
            elif kind == 5:
                p = [(a + c >> 1) + b >> 1 for a, b, c in zip(left, t, tr, strict=True)]
            elif kind == 6:
                p = [a + b >> 1 for a, b in zip(left, tl, strict=True)]
            elif kind == 7:
                p = [a + b >> 1 for a, b in zip(left, t, strict=True)]
            elif kind == 8:
                p = [a + b >> 1 for a, b in zip(tl, t, strict=True)]
            elif kind == 9:
                p = [a + b >> 1 for a, b in zip(t, tr, strict=True)]
            elif kind == 10:
                p = [(a + b >> 1) + (c + d >> 1) >> 1 for a, b, c, d in zip(left, tl, t, tr, strict=True)]
            elif kind == 11:
                p = left if sum(abs(b - c) for b, c in zip(t, tl, strict=True)) < sum(abs(a - c) for a, c in zip(left, tl, strict=True)) else t
            elif kind == 12:
                p = [min(255, max(0, a + b - c)) for a, b, c in zip(left, t, tl, strict=True)]
            elif kind == 13:
                p = [min(255, max(0, m + int((m - c) / 2))) for m, c in ((a + b >> 1, c) for a, b, c in zip(left, t, tl, strict=True))]
            else:
                p = (0, 0, 0, 255)
            left = [(a + b) & 255 for a, b in zip(line[x], p, strict=True)]
            row.append(left)
        out.append(row)
        above = row
    pixels[:] = np.array(out, np.uint8)


def _recoloured(pixels: np.ndarray, factors: np.ndarray, step: int) -> None:
    """Undo the colour transform in place; factors are pixels of blocks."""
    height, width, _ = pixels.shape
    of = np.repeat(np.repeat(factors, 1 << step, 0), 1 << step, 1)[:height, :width].view(np.int8).astype(np.int64)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(pixels[..., 1])
    red = (pixels[..., 0] + (of[..., 2] * green >> 5)) & 255
    blue = (pixels[..., 2] + (of[..., 1] * green >> 5) + (of[..., 0] * signed(red) >> 5)) & 255
    pixels[..., 0], pixels[..., 2] = red, blue


def _channels(pixels: list[int], height: int, width: int) -> np.ndarray:
    """Red, green, blue, alpha bytes."""
    v = np.array(pixels, np.uint32).reshape(height, width)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], -1).astype(np.uint8)


def decode_stream(bits: _Bits, width: int, height: int) -> np.ndarray:
    """Pixels (height, width, 4: red, green, blue, alpha) of a lossless stream after its header."""
    todo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, COLOUR):
            step = bits.read(3) + 2
            w, h = -(-wide // (1 << step)), -(-height // (1 << step))
            todo.append((kind, wide, step, _channels(_pixels(bits, w, h, False), h, w)))
        elif kind == INDEXED:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_pixels(bits, size, 1, False), 1, size)[0], 0, dtype=np.uint8)
            step = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, wide, step, table))
            wide = -(-wide // (1 << step))
        else:
            todo.append((kind, wide, 0, None))
    out = _channels(_pixels(bits, wide, height, True), height, wide)
    for kind, wide, step, table in reversed(todo):
        if kind == PREDICTOR:
            _predicted(out, table[..., 1] & 15, step)
        elif kind == COLOUR:
            _recoloured(out, table, step)
        elif kind == GREEN:
            out[..., 0] += out[..., 1]
            out[..., 2] += out[..., 1]
        else:
            size = 8 >> step
            x = np.arange(wide)
            index = out[:, x >> step, 1] >> ((x & (1 << step) - 1) * size).astype(np.uint8) & (1 << size) - 1
            out = np.concatenate([table, np.zeros((256 - len(table), 4), np.uint8)])[index]
    return out


def chunks(data: bytes) -> dict[bytes, bytes]:
    """First chunk of each kind of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("not a WebP file")
    out, at = {}, 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


def decode_webp(data: bytes) -> np.ndarray:
    """RGBA pixels (height, width, 4) of a lossless WebP file."""
    found = chunks(data)
    if b"VP8L" not in found:
        raise WebpError("only lossless WebP is read")
    bits = _Bits(found[b"VP8L"])
    if bits.read(8) != 0x2F:
        raise WebpError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("unknown version of a lossless stream")
    return decode_stream(bits, width, height)


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code of at most 15 bits for two symbols or more."""
    weight = counts.astype(np.int64)
    while True:
        heap = [(int(n), k, (k,)) for k, n in enumerate(weight) if n]
        heapq.heapify(heap)
        out = np.zeros(len(counts), np.int64)
        while len(heap) > 1:
            (a, k, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            out[list(x + y)] += 1
            heapq.heappush(heap, (a + b, k, x + y))
        if out.max() <= 15:
            return out
        weight = np.where(weight, (weight + 1) // 2, 0)


def encode_webp(pixels: np.ndarray) -> bytes:
    """Lossless WebP file of 8-bit RGBA pixels (height, width, 4)."""
    height, width, _ = pixels.shape
    if not (0 < width <= 1 << 14 and 0 < height <= 1 << 14):
        raise WebpError("a side of the image has no pixels or over 16384")
    fields: list[tuple[int, int]] = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]
    fields += [(1, 1), (GREEN, 2), (0, 1), (0, 1), (0, 1)]  # green is taken from red and blue; no more transforms, no cache, one group of codes
    flat = pixels.reshape(-1, 4).astype(np.uint8)
    order = [flat[:, 1], flat[:, 0] - flat[:, 1], flat[:, 2] - flat[:, 1], flat[:, 3]]
    words = np.zeros((len(flat), 4), np.int64)
    sizes = np.zeros((len(flat), 4), np.int64)
    for k, (channel, alphabet) in enumerate(zip(order, (280, 256, 256, 256), strict=True)):
        counts = np.bincount(channel, minlength=alphabet)
        if np.count_nonzero(counts) == 1:
            fields += [(1, 1), (0, 1), (1, 1), (int(channel[0]), 8)]
            continue
        lengths = _lengths(counts)
        # Lengths are written as they are, in a code of four bits for each of 0 to 15.
        fields += [(0, 1), (15, 4), *[(4 if s < 16 else 0, 3) for s in LENGTH_ORDER], (0, 1)]
        fields += [(int(f"{n:04b}"[::-1], 2), 4) for n in lengths.tolist()]
        most, table = _code(lengths.tolist())
        word = np.zeros(alphabet, np.int64)
        for w, entry in reversed(list(enumerate(table))):
            word[entry >> 4] = w  # the smallest is the word without bits of others
        words[:, k], sizes[:, k] = word[channel], lengths[channel]
    fields += [(1, 1), (0, 1), (0, 1), (0, 1)]  # distances: a code of one symbol
    head = "".join(f"{v:0{n}b}"[::-1] for v, n in fields)
    size, word = sizes.reshape(-1), words.reshape(-1)
    at = len(head) + np.cumsum(size) - size
    bits = np.zeros(len(head) + int(size.sum()), np.uint8)
    bits[: len(head)] = np.frombuffer(head.encode(), np.uint8) - 48
    for b in range(15):
        own = size > b
        bits[at[own] + b] = word[own] >> b & 1
    body = np.packbits(bits, bitorder="little").tobytes()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
