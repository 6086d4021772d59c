"""Lossless WebP: a stream by another encoder, round trips, and every part of the format that pixels can be written with by hand."""

import base64
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from splatlake.sources import readers, webp


class Writer:
    """Bits of a stream, the lowest first."""

    def __init__(self):
        self.bits = []

    def put(self, *fields):
        for value, n in fields:
            self.bits += [value >> k & 1 for k in range(n)]

    def flat(self, alphabet, symbols):
        """A code whose symbols (a power of two of them) all have equally long words; the words."""
        n = len(symbols).bit_length() - 1
        self.put((0, 1), (15, 4), *[(4 if s < 16 else 0, 3) for s in webp.LENGTH_ORDER], (0, 1))
        for s in range(alphabet):
            self.put((int(f"{n if s in symbols else 0:04b}"[::-1], 2), 4))
        return {s: (int(f"{k:0{n}b}"[::-1], 2), n) for k, s in enumerate(sorted(symbols))}

    def one(self, symbol):
        self.put((1, 1), (0, 1), (1, 1), (symbol, 8))

    def stream(self):
        return webp._Bits(np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes() + b"\0" * 8)


def plain_image(w, pixels):
    """An image of a few pixels without cache, all four channels by flat codes."""
    w.put((0, 1))
    codes = [w.flat(n, list(range(256))) for n in (280, 256, 256, 256)]
    w.one(0)
    for r, g, b, a in pixels:
        w.put(codes[0][g], codes[1][r], codes[2][b], codes[3][a])


def test_copies_and_cache():
    w = Writer()
    w.put((0, 1), (1, 1), (2, 4), (0, 1))  # no transforms, a cache of four, one group
    symbols = [1, 2, 3, 256 + 4, 256 + 0, 280, 281, 282]
    green = w.flat(284, symbols)
    w.one(5)  # red
    w.one(6)  # blue
    w.one(255)  # alpha
    far = w.flat(40, [0, 1])
    pixel = lambda g: 255 << 24 | 5 << 16 | g << 8 | 6
    w.put(green[1], green[2], green[3])
    w.put(green[260], (1, 1), far[1])  # length 5 + 1, distance code 2: the pixel before
    w.put(green[256], far[0])  # length 1, distance code 1: the pixel above
    slots = {(pixel(g) * webp.HASH & 0xFFFFFFFF) >> 30: g for g in (1, 2, 3)}
    slot = next(s for s in slots if s < 3)
    w.put(green[280 + slot])
    out = webp.decode_stream(w.stream(), 4, 3)[..., 1].ravel().tolist()
    first = [1, 2, 3] + [3] * 6
    assert out[:9] == first and out[9] == first[5] and out[10] == slots[slot]


def predicted(x, mode):
    """Differences of pixels to what a mode predicts, by the format's words."""
    h, wide, _ = x.shape
    v = x.astype(int)
    out = np.zeros_like(v)
    avg = lambda a, b: (a + b) // 2
    clamp = lambda a: np.clip(a, 0, 255)
    for y in range(h):
        for c in range(wide):
            left, top = v[y, c - 1], v[y - 1, c]
            tl, tr = v[y - 1, c - 1], v[y - 1, c + 1] if c + 1 < wide else v[y, 0]
            black = np.array([0, 0, 0, 255])
            if y == 0:
                p = left if c else black
            elif c == 0:
                p = top
            else:
                half = avg(left, top) - tl
                p = [black, left, top, tr, tl, avg(avg(left, tr), top), avg(left, tl), avg(left, top), avg(tl, top), avg(top, tr), avg(avg(left, tl), avg(top, tr)), left if np.abs(top - tl).sum() < np.abs(left - tl).sum() else top, clamp(left + top - tl), clamp(avg(left, top) + np.sign(half) * (np.abs(half) // 2))][mode]
            out[y, c] = (v[y, c] - p) & 255
    return out


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = np.random.default_rng(mode).integers(0, 256, (5, 6, 4))
    w = Writer()
    w.put((1, 1), (0, 2), (1, 3))
    plain_image(w, [(9, mode, 9, 9)])
    w.put((0, 1), (0, 1), (0, 1))
    codes = [w.flat(n, list(range(256))) for n in (280, 256, 256, 256)]
    w.one(0)
    for r, g, b, a in predicted(x, mode).reshape(-1, 4).tolist():
        w.put(codes[0][g], codes[1][r], codes[2][b], codes[3][a])
    assert np.array_equal(webp.decode_stream(w.stream(), 6, 5), x)


def test_colour_transform_and_several_groups():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (8, 9, 4))
    factor = (200, 37, 250)  # green to red, green to blue, red to blue: as signed bytes
    signed = lambda v: (v + 128) % 256 - 128
    y = x.copy()
    y[..., 0] = (x[..., 0] - (signed(factor[0]) * signed(x[..., 1]) >> 5)) & 255
    y[..., 2] = (x[..., 2] - (signed(factor[1]) * signed(x[..., 1]) >> 5) - (signed(factor[2]) * signed(x[..., 0]) >> 5)) & 255
    w = Writer()
    w.put((1, 1), (1, 2), (2, 3))
    plain_image(w, [(factor[2], factor[1], factor[0], 255)])
    w.put((0, 1), (0, 1), (1, 1), (0, 3))  # groups of codes in blocks of four pixels
    plain_image(w, [(0, k % 2, 0, 0) for k in range(6)])
    groups = []
    for _ in range(2):
        groups.append([w.flat(n, list(range(256))) for n in (280, 256, 256, 256)])
        w.one(0)
    for r, c in np.ndindex(8, 9):
        codes = groups[(r // 4 * 3 + c // 4) % 2]
        w.put(codes[0][int(y[r, c, 1])], codes[1][int(y[r, c, 0])], codes[2][int(y[r, c, 2])], codes[3][int(y[r, c, 3])])
    assert np.array_equal(webp.decode_stream(w.stream(), 9, 8), x)


@pytest.mark.parametrize("colours", [2, 4, 13, 200])
def test_indexed_colours(colours):
    rng = np.random.default_rng(colours)
    table, index = rng.integers(0, 256, (colours, 4)), rng.integers(0, colours, (3, 11))
    w = Writer()
    w.put((1, 1), (3, 2), (colours - 1, 8))
    plain_image(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), int)) & 255)
    step = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    size, per = 8 >> step, 1 << step
    packed = [[sum(int(v) << k * size for k, v in enumerate(row[c : c + per])) for c in range(0, 11, per)] for row in index]
    w.put((0, 1), (0, 1), (0, 1))
    codes = w.flat(280, list(range(256)))
    for _ in range(3):
        w.one(0)
    w.one(0)
    for row in packed:
        for v in row:
            w.put(codes[v])
    assert np.array_equal(webp.decode_stream(w.stream(), 11, 3), table[index])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 7, 256]))
def test_round_trips(height, width, seed, values):
    x = np.random.default_rng(seed).integers(0, values, (height, width, 4), dtype=np.uint8)
    data = webp.encode_webp(x)
    assert len(data) % 2 == 0 and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    assert np.array_equal(webp.decode_webp(data), x) and np.array_equal(readers.decode_texture(data), x)


def test_skewed_counts_keep_words_short():
    counts = np.array([int(1.7**k) for k in range(40)])
    lengths = webp._lengths(counts)
    assert lengths.max() <= 15 and sum(2.0**-n for n in lengths) == 1.0


def test_what_is_no_image():
    good = webp.encode_webp(np.arange(400, dtype=np.uint8).reshape(10, 10, 4))
    for bad in (b"", b"RIFF", good[:40], good.replace(b"VP8L", b"VP8 "), good[:20] + b"\0" + good[21:], good[:24] + b"\xff" * 60 + good[84:]):
        with pytest.raises(readers.SourceError):
            readers.decode_texture(bad)


# The opacity of a 16 x 16 icon as a lossless stream of another encoder (without the header of a file), with the checksum of its pixels.
ICON = "J6KokSTleucYX+ffKpmImP90cY3gJjDi4Yt3MsjBEVyDKzDosHgVjnhRNcEIDAJPkqBqsFUZHNa2bUYvTsZ2PLbtd/uvKa4hov9J0f2PkPe6REkkGzolkTTzFG0Ox9PlFiD0CxS+kOGDtxoynjaCfx0pfk52CPuInrOR75lzRugygtv4zEiy90UwfSD9NheMITJWLaXWayO8XeOlWRXVnIGk2W6WdYoYMQ+KqixQNPowgt+6a1BSKbUtz+lUFAoBAAA="


def test_stream_of_another_encoder():
    out = webp.decode_stream(webp._Bits(base64.b64decode(ICON)), 16, 16)[..., 1]
    assert out[4].tolist() == [189, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 72, 255, 247, 130, 10] and out[:, 0].tolist() == [0, 0, 0, 0, 189, 255, 255, 255, 247, 215, 111, 8, 2, 0, 0, 0]
    assert zlib.crc32(out.tobytes()) == 2550879177
