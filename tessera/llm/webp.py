"""Lossless WebP (VP8L) in numpy: a decoder for the whole format and an encoder.

The decoder reads prefix codes, meta prefix codes, back-references and the
colour cache, and inverts the predictor, cross-colour, subtract-green and
colour-indexing transforms. Images whose red, blue and alpha codes have one
symbol each (grey and palette images) take a vectorised way: the code length at
every bit position comes from one table look-up, then a walk follows them.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import accumulate

import numpy as np

# Fixed values of the format: the order in which the lengths of the code-length
# code are stored, and the (x, y) offsets of the 120 short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
SIGNATURE, MAX_SIDE, CACHE_MULTIPLIER = 0x2F, 1 << 14, 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Reads little-endian bit fields, by way of a window of 64 bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.first, self.window = data, 0, 0, int.from_bytes(data[:64], "little")

    def _ahead(self) -> int:
        past = self.at - self.first
        if not 0 <= past <= 448:
            self.first = self.at & ~7
            self.window = int.from_bytes(self.data[self.first >> 3 : (self.first >> 3) + 64], "little")
            past = self.at - self.first
        return self.window >> past

    def get(self, n: int) -> int:
        value = self._ahead() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image data end early")
        return value


@lru_cache(16)
def reversed_bits(n: int) -> np.ndarray:
    """Each ``n``-bit number with its bits in reverse."""
    value, out = np.arange(1 << n, dtype=np.int64), np.zeros(1 << n, np.int64)
    for b in range(n):
        out |= ((value >> b) & 1) << (n - 1 - b)
    return out


class PrefixCode:
    """A canonical prefix code as a table over as many bits as its longest word.

    In order of length, then symbol, the words fill the number line from zero
    on; the stream has their bits in reverse.
    """

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else (0 if not len(used) else None)
        if self.only is not None:
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        sizes = lengths[order]
        self.longest = int(sizes[-1])
        spans = 1 << (self.longest - sizes.astype(np.int64))
        if int(spans.sum()) != 1 << self.longest:
            raise ValueError("a prefix code is incomplete or oversubscribed")
        turned = reversed_bits(self.longest)
        self.lengths = np.repeat(sizes.astype(np.uint8), spans)[turned]
        self.symbols = np.repeat(order.astype(np.int32), spans)[turned]
        self.mask = (1 << self.longest) - 1
        starts = np.cumsum(spans) - spans
        self.order, self.sizes, self.words = order, sizes, turned[starts]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        window = bits._ahead() & self.mask
        bits.at += int(self.lengths[window])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image data end early")
        return int(self.symbols[window])


@lru_cache(1024)
def only_code(symbol: int) -> PrefixCode:
    """The code of one symbol, which takes no bits."""
    lengths = np.zeros(symbol + 1, np.uint8)
    lengths[symbol] = 1
    return PrefixCode(lengths)


def codes_of(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """Symbol to (code word as the stream has it, length)."""
    code = PrefixCode(lengths)
    return dict(zip(code.order.tolist(), zip(code.words.tolist(), code.sizes.tolist(), strict=True), strict=True))


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.get(1):
        two = bits.get(1)
        first = bits.get(8 if bits.get(1) else 1)
        if not two and first < alphabet:
            return only_code(first)
        lengths[first] = 1
        if two:
            lengths[bits.get(8)] = 1
        return PrefixCode(lengths)
    own = np.zeros(19, np.uint8)
    for k in range(4 + bits.get(4)):
        own[LENGTH_ORDER[k]] = bits.get(3)
    meta = PrefixCode(own)
    left = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else alphabet
    sizes, symbols, mask = ([0], [meta.only], 0) if meta.only is not None else (meta.lengths.tolist(), meta.symbols.tolist(), meta.mask)
    # All that the lengths can take: up to 14 bits each.
    start, room = bits.at >> 3, 2 * alphabet + 8
    window, found, last, read = int.from_bytes(bits.data[start : start + room], "little") >> (bits.at & 7), [], 8, 0
    while len(found) < alphabet and left:
        left -= 1
        n, size = symbols[window & mask], sizes[window & mask]
        window >>= size
        if n < 16:
            found.append(n)
            last = n or last
        else:
            extra = 2 if n == 16 else 3 if n == 17 else 7
            found += [last if n == 16 else 0] * ((11 if n == 18 else 3) + (window & ((1 << extra) - 1)))
            window >>= extra
            size += extra
        read += size
    bits.at += read
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image data end early")
    if len(found) > alphabet:
        raise ValueError("code lengths run over the alphabet")
    lengths[: len(found)] = found
    return PrefixCode(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.get(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as packed ARGB."""
    cache_bits = bits.get(4) if bits.get(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, block, groups = None, 0, 1
    if main and bits.get(1):
        block = bits.get(3) + 2
        across = -(-width // (1 << block))
        meta = (read_pixels(bits, across, -(-height // (1 << block)), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    if meta is None and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        return _one_channel(bits, codes[0], width, height)
    out, cache, pushed, at, n = [0] * (width * height), [0] * cache_size, 0, 0, width * height
    shift = 32 - cache_bits

    def remember(upto: int) -> int:
        for value in out[pushed:upto]:
            cache[((value * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = value
        return upto

    while at < n:
        green, red, blue, alpha, far = codes[int(meta[(at // width >> block) * across + (at % width >> block)]) if meta is not None else 0]
        symbol = green.read(bits)
        if symbol < 256:
            r, b = red.read(bits), blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < 280:
            times = _extended(bits, symbol - 256)
            back = _distance(_extended(bits, far.read(bits)), width)
            if back > at or at + times > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + times):
                out[k] = out[k - back]
            at += times
        else:
            pushed = remember(at)
            out[at] = cache[symbol - 280]
            at += 1
        if cache_bits:
            pushed = remember(at)
    return np.asarray(out, np.uint32)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _one_channel(bits: Bits, codes: list[PrefixCode], width: int, height: int) -> np.ndarray:
    """Pixels that differ in green only."""
    green, red, blue, alpha, far = codes
    rest, n = np.uint32(alpha.only << 24 | red.only << 16 | blue.only), width * height
    if green.only is not None and green.only < 256:
        return np.full(n, rest | np.uint32(green.only << 8), np.uint32)
    # At each byte the next three, and zero past the data.
    raw = bits.data[bits.at >> 3 :]
    wide = np.ndarray((len(raw) + 1,), "<u4", raw + bytes(4), strides=(1,)) & np.uint32(0xFFFFFF)
    mask, lengths = np.uint32(green.mask), np.zeros((len(wide) + 32, 8), np.uint8)
    lengths[:-32] = green.lengths.take((wide[:, None] >> np.arange(8, dtype=np.uint32)) & mask)
    # Where one, two, four and eight words from each bit position end; past the data, nowhere.
    one = lengths.ravel()
    place = np.arange(one.size - 64)
    two = np.zeros(one.size, np.uint8)
    np.add(one[:-64], one.take(place + one[:-64]), out=two[:-64])
    four = two[:-64] + two.take(place + two[:-64])
    eight = four[:-64] + four.take(place[:-64] + four[:-64])
    steps, base, out, got, many = eight.tobytes(), bits.at & ~7, np.zeros(n, np.uint32), 0, 1 << 20
    try:
        while got < n:
            # After a reference the next one may be near: look a little ahead, then farther.
            ask = min(n - got, 4 * many)
            eighth = np.fromiter(accumulate(range((ask - 1) // 8), lambda p, _: p + steps[p], initial=bits.at - base), np.int64)
            at = np.empty((len(eighth), 8), np.int64)
            at[:, 0], at[:, 4] = eighth, eighth + four[eighth]
            at[:, 2::4] = at[:, ::4] + two[at[:, ::4]]
            at[:, 1::2] = at[:, ::2] + one[at[:, ::2]]
            at = at.ravel()[:ask]
            symbols = green.symbols[(wide[np.minimum(at >> 3, len(wide) - 1)] >> (at & 7).astype(np.uint32)) & mask]
            special = np.flatnonzero(symbols >= 256)
            upto, many = (int(special[0]), 16) if len(special) else (len(symbols), 4 * many)
            out[got : got + upto] = symbols[:upto]
            got += upto
            last = int(at[min(upto, len(at) - 1)])
            bits.at = base + last + int(one[last])
            if upto < len(symbols):
                times = _extended(bits, int(symbols[upto]) - 256)
                back = _distance(_extended(bits, far.read(bits)), width)
                if back > got or got + times > n:
                    raise ValueError("a back-reference leaves the image")
                out[got : got + times] = np.resize(out[got - back : min(got, got - back + times)], times)
                got += times
    except IndexError:
        raise ValueError("the image data end early") from None
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image data end early")
    return out << np.uint32(8) | rest


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _guess(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The predictor ``mode`` from four neighbours, each four int channels."""
    if mode == 11:
        over = int(np.abs(top - corner).sum()) < int(np.abs(left - corner).sum())
        return left if over else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _mean(left, top)
        half = (mean - corner) / 2
        return np.clip(mean + np.trunc(half).astype(np.int64), 0, 255)
    return {
        0: lambda: np.array([255, 0, 0, 0]), 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: _mean(_mean(left, right), top), 6: lambda: _mean(left, corner), 7: lambda: _mean(left, top),
        8: lambda: _mean(corner, top), 9: lambda: _mean(top, right), 10: lambda: _mean(_mean(left, corner), _mean(top, right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0]))()


def channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def packed(parts: np.ndarray) -> np.ndarray:
    a, r, g, b = (parts[..., k].astype(np.uint32) & np.uint32(255) for k in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _predict_runs(pixels: np.ndarray, width: int, height: int, mode: int, sign: int) -> np.ndarray:
    """``predict`` with the left (1) or the upper (2) neighbour all over: sums or differences of whole runs.

    The first row always goes by its left neighbour, the first column by its upper one.
    """
    rows = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(height, width, 4)
    edge, inner = (rows[:, 0], rows) if mode == 1 else (rows[0], rows)
    out = np.empty_like(rows)
    axis = 1 if mode == 1 else 0
    black = np.array([0, 0, 0, 255], np.uint8)
    if sign > 0:
        first = np.cumsum(edge, axis=0, dtype=np.uint8) + black
        out[...] = inner
        if mode == 1:
            out[:, 0] = first
        else:
            out[0] = first
        np.cumsum(out, axis=axis, dtype=np.uint8, out=out)
    else:
        out[...] = inner
        if mode == 1:
            out[:, 1:] -= inner[:, :-1]
            out[1:, 0] = inner[1:, 0] - inner[:-1, 0]
        else:
            out[1:] -= inner[:-1]
            out[0, 1:] = inner[0, 1:] - inner[0, :-1]
        out[0, 0] = inner[0, 0] - black
    return out.reshape(-1).view("<u4").astype(np.uint32)


def predict(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Adds (``sign`` 1) or takes away (-1) what the predictors say."""
    used = np.unique((modes >> np.uint32(8)) & np.uint32(15))
    if len(used) == 1 and used[0] in (1, 2):
        return _predict_runs(pixels, width, height, int(used[0]), sign)
    given = channels(pixels).reshape(height * width, 4)
    done = np.zeros_like(given) if sign > 0 else given
    out, across = np.zeros_like(given), -(-width // (1 << block))
    for at in range(height * width):
        y, x = divmod(at, width)
        if at == 0:
            guess = np.array([255, 0, 0, 0])
        elif y == 0:
            guess = done[at - 1]
        elif x == 0:
            guess = done[at - width]
        else:
            mode = int(modes[(y >> block) * across + (x >> block)] >> 8) & 15
            guess = _guess(mode, done[at - 1], done[at - width], done[at - width + 1], done[at - width - 1])
        out[at] = (given[at] + sign * guess) & 255
        if sign > 0:
            done[at] = out[at]
    return packed(out)


def cross_colour(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Inverts (``sign`` 1) or applies (-1) the cross-colour transform."""
    parts, across = channels(pixels), -(-width // (1 << block))
    at = np.arange(width * height)
    own = channels(factors)[(at // width >> block) * across + (at % width >> block)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    red, green, blue = parts[:, 1].copy(), parts[:, 2], parts[:, 3].copy()
    parts[:, 1] = (red + sign * delta(own[:, 3], green)) & 255
    full = parts[:, 1] if sign > 0 else red
    parts[:, 3] = (blue + sign * (delta(own[:, 2], green) + delta(own[:, 1], full))) & 255
    return packed(parts)


def with_green(pixels: np.ndarray) -> np.ndarray:
    """Inverts the subtract-green transform."""
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    sides = (pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
    return (pixels & np.uint32(0xFF00FF00)) | (sides & np.uint32(0x00FF00FF))


def _bundle(colours: int) -> int:
    """How many times (as a power of 2) palette indices share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundle(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    """Palette indices, several to a pixel if there are few colours, to colours."""
    index, share = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64), _bundle(len(palette))
    if share:
        size = 8 >> share
        index = ((index[:, None] >> (size * np.arange(1 << share))) & ((1 << size) - 1)).reshape(height, -1)[:, :width].ravel()
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode_vp8l(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and packed ARGB pixels of a VP8L stream."""
    bits = Bits(data)
    if bits.get(8) != SIGNATURE:
        raise ValueError("not a VP8L stream")
    width, height = bits.get(14) + 1, bits.get(14) + 1
    bits.get(1)
    if bits.get(3):
        raise ValueError("unknown VP8L version")
    undo, inner = [], width
    while bits.get(1):
        kind = bits.get(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.get(3) + 2
            undo.append((kind, block, inner, read_pixels(bits, -(-inner // (1 << block)), -(-height // (1 << block)), False)))
        elif kind == PALETTE:
            size = bits.get(8) + 1
            steps = channels(read_pixels(bits, size, 1, False))
            undo.append((kind, size, inner, packed(np.cumsum(steps, axis=0) & 255)))
            inner = -(-inner // (1 << _bundle(size)))
        else:
            undo.append((kind, 0, inner, None))
    pixels = read_pixels(bits, inner, height, True)
    for kind, block, across, side in reversed(undo):
        if kind == PREDICTOR:
            pixels = predict(pixels, across, height, side, block, 1)
        elif kind == CROSS_COLOR:
            pixels = cross_colour(pixels, across, height, side, block, 1)
        elif kind == PALETTE:
            pixels = unbundle(pixels, across, height, side)
        else:
            pixels = with_green(pixels)
    return width, height, pixels


def decode_webp(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and packed ARGB pixels of a lossless WebP file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return decode_vp8l(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in this WebP file")


class BitWriter:
    """Collects bit fields; runs of codes are packed with numpy."""

    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def run(self, words: np.ndarray, lengths: np.ndarray) -> None:
        """Appends many codes of up to 32 bits."""
        if not len(words):
            return
        ends = np.cumsum(lengths, dtype=np.int64) + (self.n & 31)
        keep = self.n & ~31
        starts = ends - lengths
        moved = words.astype(np.uint64) << (starts & 31).astype(np.uint64)
        slot = starts >> 5
        first = np.append(0, np.flatnonzero(slot[1:] != slot[:-1]) + 1)
        joined = np.bitwise_or.reduceat(moved, first)
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint32)
        out[slot[first]] = (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out[slot[first] + 1] |= (joined >> np.uint64(32)).astype(np.uint32)
        self.value |= int.from_bytes(out.tobytes(), "little") << keep
        self.n = keep + int(ends[-1])

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; counts are flattened till they fit."""
    out, used = np.zeros(len(counts), np.uint8), np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, nxt = [0] * (2 * len(weights) - 1), len(weights)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = nxt
            heapq.heapreplace(heap, (a + b, nxt))
            nxt += 1
        depth = [0] * nxt
        for k in range(nxt - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(weights)]) <= most:
            out[used] = depth[: len(weights)]
            return out
        weights = [w // 4 + 1 for w in weights]


@lru_cache(1)
def _length_words() -> dict[int, tuple[int, int]]:
    """The code for code lengths: 13 words of four bits and 6 of five."""
    return codes_of(np.array([4] * 13 + [5] * 6, np.uint8))


def write_first(out: BitWriter, symbol: int, more: bool = False) -> None:
    """Stores a prefix code of one symbol, or the first of two."""
    out.put(1 | int(more) << 1 | int(symbol > 1) << 2, 3)
    out.put(symbol, 8 if symbol > 1 else 1)


def write_code(out: BitWriter, lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """Stores a prefix code; returns its words (no bits if it has one symbol)."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        write_first(out, first, len(used) == 2)
        if len(used) == 2:
            out.put(int(used[1]), 8)
        return codes_of(lengths) if len(used) == 2 else {first: (0, 0)}
    out.put(0, 1)
    out.put(15, 4)
    for symbol in LENGTH_ORDER:
        out.put(4 if symbol < 13 else 5, 3)
    stop = max(2, int(used[-1]) + 1)
    given, tokens, at = lengths[:stop].tolist(), [], 0
    while at < stop:
        n = 1
        while given[at] == 0 and n < 138 and at + n < stop and given[at + n] == 0:
            n += 1
        if n < 3:
            tokens += [(given[at], 0, 0)]
            n = 1
        else:
            tokens += [(17, n - 3, 3) if n <= 10 else (18, n - 11, 7)]
        at += n
    out.put(1, 1)
    out.put(4, 3)
    out.put(max(2, len(tokens)) - 2, 10)
    for symbol, extra, n in tokens + [(0, 0, 0)] * (2 - len(tokens)):
        word, size = _length_words()[symbol]
        out.put(word | extra << size, size + n)
    return codes_of(lengths) if len(used) > 1 else {int(used[0]): (0, 0)}


def _split_extended(value: int) -> tuple[int, int, int]:
    """Prefix, number of extra bits and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    top = value.bit_length() - 1
    second = (value >> (top - 1)) & 1
    return 2 * top + second, top - 1, value & ((1 << (top - 1)) - 1)


def find_repeats(pixels: np.ndarray, least: int = 4, most: int = 4096) -> list[tuple[int, int, int]]:
    """Greedy (position, length, distance) of repeats, by a hash of the next four pixels."""
    seen, found, at, values = {}, [], 0, pixels.tolist()
    while at + least <= len(values):
        key = tuple(values[at : at + least])
        before = seen.get(key)
        seen[key] = at
        n = 0
        if before is not None:
            while n < most and at + n < len(values) and values[before + n] == values[at + n]:
                n += 1
        if n >= least:
            found.append((at, n, at - before))
            at += n
        else:
            at += 1
    return found


def write_pixels(out: BitWriter, pixels: np.ndarray, main: bool, repeats: bool = False, cache_bits: int = 0) -> None:
    """An entropy-coded image with one group of codes."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    one = not repeats and not cache_bits
    fields = [(pixels >> np.uint32(s)) & np.uint32(255) for s in (8, 16, 0, 24)]
    if one:
        counts = [np.bincount(f, minlength=256) if len(f) and (f[0] != f[-1] or (f != f[0]).any()) else np.bincount(f[:1], minlength=256) for f in fields]
        codes = [write_code(out, code_lengths(c)) for c in counts]
        write_code(out, np.zeros(40, np.uint8))
        keep, words, sizes = [k for k in range(4) if len(codes[k]) > 1], [], []
        for k in keep:
            table = np.zeros((2, 256), np.int64)
            table[:, list(codes[k])] = np.array(list(codes[k].values())).T
            words.append(table[0][fields[k]])
            sizes.append(table[1][fields[k]])
        if keep:
            out.run(np.stack(words, 1).ravel(), np.stack(sizes, 1).ravel())
        return
    spans, tokens, cache, at = {a: (n, d) for a, n, d in (find_repeats(pixels) if repeats else [])}, [], [None] * (1 << cache_bits), 0
    values = pixels.tolist()
    key = lambda v: ((v * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
    while at < len(values):
        n, back = spans.get(at, (1, 0))
        if back:
            tokens.append(("copy", _split_extended(n), _split_extended(back + 120)))
        elif cache_bits and cache[key(values[at])] == values[at]:
            tokens.append(("cache", key(values[at])))
        else:
            tokens.append(("pixel", at))
        for value in values[at : at + n]:
            cache[key(value)] = value
        at += n
    stats = [np.zeros(n, np.int64) for n in (280 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)]
    for token in tokens:
        if token[0] == "copy":
            stats[0][256 + token[1][0]] += 1
            stats[4][token[2][0]] += 1
        elif token[0] == "cache":
            stats[0][280 + token[1]] += 1
        else:
            for k in range(4):
                stats[k][fields[k][token[1]]] += 1
    codes = [write_code(out, code_lengths(s)) for s in stats]
    for token in tokens:
        if token[0] == "copy":
            out.put(*codes[0][256 + token[1][0]])
            out.put(token[1][2], token[1][1])
            out.put(*codes[4][token[2][0]])
            out.put(token[2][2], token[2][1])
        elif token[0] == "cache":
            out.put(*codes[0][280 + token[1]])
        else:
            for k in range(4):
                out.put(*codes[k][int(fields[k][token[1]])])


def _container(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def _head(width: int, height: int, alpha: bool) -> BitWriter:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError("an image side is 1 to 16384 pixels")
    out = BitWriter()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        out.put(value, n)
    return out


def far_repeats(samples: np.ndarray, least: int = 32, most: int = 4096) -> list[tuple[int, int, int]]:
    """(position, length, distance) of long repeats of 8-bit samples, in order.

    Places are compared whose next eight samples have a certain hash, one of 16
    on the average: equal content has them at equal places. Repeats are then
    extended both ways, if twelve samples more are equal on one side: of
    ``least`` samples, 24 at least are outside the eight.
    """
    if len(samples) < 2 * least:
        return []
    windows = np.ndarray((len(samples) - 7,), "<u8", samples.tobytes(), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    marks = np.flatnonzero(windows >> np.uint64(60) == 0)
    _, first, kind = np.unique(windows[marks], return_index=True, return_inverse=True)
    found, done = [], 0
    again = np.flatnonzero(first[kind] != np.arange(len(marks)))
    here, there, last = marks[again], marks[first[kind[again]]], len(windows) - 1
    same = lambda by: (windows[np.clip(here + by, 0, last)] == windows[np.clip(there + by, 0, last)]) | (there + by < 0) | (here + by > last)
    likely = (same(8) & same(12)) | (same(-8) & same(-12)) if least >= 32 else slice(None)
    for at, before in zip(here[likely].tolist(), there[likely].tolist(), strict=True):
        if at < done:
            continue
        back = min(at - done, before, 256)
        differs = np.flatnonzero(samples[at - back : at] != samples[before - back : before])
        back = back - int(differs[-1]) - 1 if len(differs) else back
        ahead = min(len(samples) - at, most - back)
        differs = np.flatnonzero(samples[at : at + ahead] != samples[before : before + ahead])
        ahead = int(differs[0]) if len(differs) else ahead
        if back + ahead >= least:
            found.append((at - back, back + ahead, at - before))
            done = at + ahead
    return found


def write_green(out: BitWriter, green: np.ndarray, rest: int, spans: list[tuple[int, int, int]]) -> None:
    """An entropy-coded main image that varies in green only, with back-references."""
    out.put(0, 2)
    literal, copies, at = [], [], 0
    for start, length, distance in spans:
        literal.append(green[at:start])
        copies.append((*_split_extended(length), *_split_extended(distance + 120)))
        at = start + length
    literal.append(green[at:])
    counts, far = np.bincount(np.concatenate(literal), minlength=280), np.zeros(40, np.int64)
    for c in copies:
        counts[256 + c[0]] += 1
        far[c[3]] += 1
    codes = write_code(out, code_lengths(counts))
    for shift in (16, 0, 24):
        write_first(out, rest >> shift & 255)
    fars = write_code(out, code_lengths(far))
    table = np.zeros((2, 280), np.int64)
    table[:, list(codes)] = np.array(list(codes.values())).T
    words, sizes = [], []
    for part, copy in zip(literal, [*copies, None], strict=True):
        words.append(table[0][part])
        sizes.append(table[1][part])
        if copy:
            four = (codes[256 + copy[0]], (copy[2], copy[1]), fars[copy[3]], (copy[5], copy[4]))
            words.append(np.array([w for w, _ in four]))
            sizes.append(np.array([n for _, n in four]))
    out.run(np.concatenate(words), np.concatenate(sizes))


def _cost(samples: np.ndarray) -> float:
    """Bits of the samples under their own best prefix code, about."""
    counts = np.bincount(samples, minlength=256)
    counts = counts[counts > 0]
    return float(len(samples) * np.log2(len(samples)) - (counts * np.log2(counts)).sum()) if len(samples) else 0.0


def plan_grey(samples: np.ndarray, width: int) -> dict:
    """What serves these samples best: a palette, a predictor, back-references or none.

    Two to four values are bundled by a palette, four or eight to a pixel. A predictor is taken if it saves a
    tenth of the bits; otherwise long repeats become back-references.
    """
    values = np.count_nonzero(np.bincount(samples, minlength=256))
    if values <= 4:
        return {"palette": values > 1}
    rows = samples.reshape(-1, width)
    plain, by_left = _cost(samples), _cost((rows[:, 1:] - rows[:, :-1]).ravel())
    by_top = _cost((rows[1:] - rows[:-1]).ravel()) if len(rows) > 2 else plain
    if min(by_left, by_top) < 0.9 * plain:
        return {"mode": 1 if by_left <= by_top else 2}
    return {"spans": far_repeats(samples)}


def encode_grey(samples: np.ndarray, width: int, palette: bool = False, mode: int = 0, spans: list[tuple[int, int, int]] | None = None) -> bytes:
    """A grey image of 8-bit samples as WebP, with one prefix code for its pixels.

    Grey has equal channels: with green subtracted, or as palette indices, only
    the green channel holds anything. ``mode`` names a predictor for all of it,
    ``spans`` back-references.
    """
    height = len(samples) // width
    out = _head(width, height, False)
    out.put(1, 1)
    index = samples
    if palette:
        out.put(PALETTE, 2)
        colours = np.flatnonzero(np.bincount(samples, minlength=256))
        place = np.zeros(256, np.int64)
        place[colours] = np.arange(len(colours))
        out.put(len(colours) - 1, 8)
        parts = channels(np.uint32(0xFF000000) | colours.astype(np.uint32) * np.uint32(0x010101))
        write_pixels(out, packed(np.diff(parts, axis=0, prepend=0) & 255), False)
        index, share = place[samples], _bundle(len(colours))
        if share:
            size, each = 8 >> share, 1 << share
            rows = np.zeros((height, -(-width // each) * each), np.int64)
            rows[:, :width] = index.reshape(height, width)
            index = (rows.reshape(height, -1, each) << (size * np.arange(each))).sum(axis=2).ravel()
    else:
        out.put(SUBTRACT_GREEN, 2)
    if mode:
        pixels = np.uint32(0xFF000000) | index.astype(np.uint32) << np.uint32(8)
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(7, 3)
        side = np.full(-(-width // 512) * -(-height // 512), 0xFF000000 | mode << 8, np.uint32)
        write_pixels(out, side, False)
        pixels = predict(pixels, width, height, side, 9, -1)
    out.put(0, 1)
    if mode:
        write_pixels(out, pixels, True)
    else:
        write_green(out, index, 0xFF000000, spans or [])
    return _container(out.bytes())


def encode_argb(pixels: np.ndarray, width: int, transforms: tuple[int, ...] = (), block: int = 2, repeats: bool = False, cache_bits: int = 0, modes: np.ndarray | None = None, factors: np.ndarray | None = None) -> bytes:
    """A colour image as WebP, with any of the pixel transforms."""
    height = len(pixels) // width
    out = _head(width, height, True)
    tiles = -(-width // (1 << block)) * -(-height // (1 << block))
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == SUBTRACT_GREEN:
            parts = channels(pixels)
            parts[:, 1] -= parts[:, 2]
            parts[:, 3] -= parts[:, 2]
            pixels = packed(parts)
            continue
        out.put(block - 2, 3)
        if kind == PREDICTOR:
            side = np.uint32(0xFF000000) | (modes if modes is not None else np.arange(tiles) % 14).astype(np.uint32) << np.uint32(8)
            pixels = predict(pixels, width, height, side, block, -1)
        else:
            side = factors if factors is not None else np.uint32(0xFF000000) | (np.arange(tiles).astype(np.uint32) * np.uint32(0x01070B)) & np.uint32(0xFFFFFF)
            pixels = cross_colour(pixels, width, height, side, block, -1)
        write_pixels(out, side, False)
    out.put(0, 1)
    write_pixels(out, pixels, True, repeats, cache_bits)
    return _container(out.bytes())
