"""Lossless WebP: a decoder for every feature of the format, and an encoder whose images use them.

The decoder reads prefix codes, back-references and the colour cache, then inverts the transforms (predictor,
cross-colour, subtract-green, palette) in reverse order. Pixels are ARGB as unsigned 32-bit integers.

Most symbols of an image whose red, blue and alpha codes have a single symbol (a palette image, say) are green
literals. For those the decoder looks up what a code would be at *every* bit position at once, and then only follows
the chain of positions; a back-reference interrupts the chain. Everything else goes symbol by symbol.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
MAX_SIDE, MAX_COPY, MAX_DISTANCE = 1 << 14, 4096, (1 << 20) - 120
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: Bits of a main image that are looked up at once.
WINDOW = 1 << 21
#: The places (to the left, upwards) that the first 120 distance codes mean.
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


class WebpError(ValueError):
    """The bytes are no lossless WebP image."""


# -- prefix codes -----------------------------------------------------------------------------------------------------


class Code:
    """A canonical prefix code from its code lengths, with a table over the next `width` bits."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if len(used) < 2:
            self.width, self.only = 0, int(used[0]) if len(used) else 0
            return
        self.only = None
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        self.width = int(size[-1])
        if int((1 << (self.width - size)).sum()) != 1 << self.width:
            raise WebpError("a prefix code isn't complete")
        spread = 1 << (self.width - size)
        back = _backwards(self.width)
        self.symbols, self.lengths = np.repeat(order, spread)[back], np.repeat(size, spread)[back]
        self.symbol_of, self.length_of = self.symbols.data, self.lengths.data  # quicker for single places


def _reversed16() -> np.ndarray:
    x = np.arange(1 << 16)
    for mask, shift in ((0x5555, 1), (0x3333, 2), (0x0F0F, 4), (0x00FF, 8)):
        x = (x & mask) << shift | (x >> shift) & mask
    return x


_REVERSED = _reversed16()


def reverse(x: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    """x with its lowest `bits` bits (at most 16) in reverse order."""
    return _REVERSED[x] >> (16 - bits)


@lru_cache(maxsize=32)
def _backwards(width: int) -> np.ndarray:
    return reverse(np.arange(1 << width), width)


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `limit` bits; 0 for what doesn't occur."""
    counts = np.asarray(counts, dtype=np.int64)
    used = counts.nonzero()[0].tolist()
    out = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        n = len(used)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            w, a = heapq.heappop(heap)
            v, b = heap[0]
            parent[a] = parent[b] = node
            heapq.heapreplace(heap, (w + v, node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        weights = [(w + 1) // 2 + 1 for w in weights]


def codewords(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest."""
    out = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order]
        step = 1 << (15 - size)
        out[order] = reverse((np.cumsum(step) - step) >> (15 - size), size)
    return out


# -- decoding ---------------------------------------------------------------------------------------------------------


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        value = int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)
        self.at = at + n
        if self.at > self.end:
            raise WebpError("the data end too early")
        return value

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        at = self.at
        k = int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << code.width) - 1)
        self.at = at + code.length_of[k]
        if self.at > self.end:
            raise WebpError("the data end too early")
        return code.symbol_of[k]

    def value(self, prefix: int) -> int:
        """The length or distance code that a prefix symbol begins."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


def _payload(data: bytes) -> bytes:
    """The lossless image of a file: its VP8L chunk, alone or among those of the extended format."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] not in (b"VP8L", b"VP8X"):
        raise WebpError("no lossless WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise WebpError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """The pixels of an image file, height x width, as ARGB."""
    bits = Bits(_payload(data))
    if bits.read(8) != 0x2F:
        raise WebpError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # a hint that alpha is used
    if bits.read(3):
        raise WebpError("unknown version")
    transforms, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t[0] for t in transforms}:
            raise WebpError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            blocks = _image(bits, _up(now, size), _up(height, size), False)
            transforms.append((kind, now, size, blocks))
        elif kind == GREEN:
            transforms.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            colours = _add_up(_image(bits, n, 1, False)[0])
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, now, pack, colours))
            now = _up(now, pack)
    pixels = _image(bits, now, height, True)
    for kind, now, size, extra in reversed(transforms):
        pixels = (_undo_predictor, _undo_cross, _undo_green, _undo_palette)[kind](pixels, now, size, extra)
    return pixels


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


@lru_cache(maxsize=256)
def _single(symbol: int) -> Code:
    """The code of one symbol, which takes no bits."""
    lengths = np.zeros(symbol + 1, dtype=np.int64)
    lengths[symbol] = 1
    return Code(lengths)


def _code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise WebpError("a symbol is outside its alphabet")
        if not two:
            return _single(symbols[0])
        lengths = np.zeros(alphabet, dtype=np.int64)
        lengths[symbols] = 1
        return Code(lengths)
    first = np.zeros(19, dtype=np.int64)
    for i in range(bits.read(4) + 4):
        first[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    out, last, at, have, held = [], 8, bits.at, 0, 0
    low, sizes, symbols = (1 << code.width) - 1, *((code.length_of, code.symbol_of) if code.only is None else (None, None))
    while len(out) < alphabet and left:
        left -= 1
        if have < 14:  # a length of 7 bits at most, and 7 more
            held, have = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 56
        s, used = code.only, 0
        if s is None:
            k = held & low
            s, used = symbols[k], sizes[k]
        if s < 16:
            out.append(s)
            last = s or last
        else:
            base, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
            times = base + (held >> used & ((1 << extra) - 1))
            used += extra
            out += [last if s == 16 else 0] * times
        at, held, have = at + used, held >> used, have - used
        if at > bits.end:
            raise WebpError("the data end too early")
    bits.at = at
    if len(out) > alphabet:
        raise WebpError("code lengths run over the alphabet")
    return Code(np.array(out, dtype=np.int64))


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; only the main one may have several groups of prefix codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    groups, where, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        where = (_image(bits, _up(width, shift), _up(height, shift), False) >> 8) & 0xFFFF
        groups = int(where.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    codes = [[_code(bits, n) for n in (256 + 24 + cache, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache and all(c.only is not None for c in codes[0][1:4]):
        pixels = _green_only(bits, codes[0], width, total)
    else:
        pixels = _general(bits, codes, where, shift, cache_bits, width, total)
    return pixels.reshape(height, width)


def _distance(bits: Bits, code: Code, width: int) -> int:
    d = bits.value(bits.symbol(code))
    if d > len(NEAR):
        return d - len(NEAR)
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def _general(bits: Bits, codes: list, where: np.ndarray | None, shift: int, cache_bits: int, width: int, total: int) -> np.ndarray:
    out, cache = [0] * total, [0] * (1 << cache_bits)
    i, cached = 0, 0  # pixels so far, and those of them that are in the cache
    while i < total:
        green, red, blue, alpha, distance = codes[where[i // width >> shift, i % width >> shift] if where is not None else 0]
        s = bits.symbol(green)
        if s < 256:
            r, b, a = bits.symbol(red), bits.symbol(blue), bits.symbol(alpha)
            out[i] = a << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 280:
            n = bits.value(s - 256)
            back = _distance(bits, distance, width)
            if back > i or i + n > total:
                raise WebpError("a back-reference leaves the image")
            for i in range(i, i + n):
                out[i] = out[i - back]
            i += 1
        else:
            while cached < i:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, dtype=np.uint32)


def _green_only(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    green, distance = codes[0], codes[4]
    rest = np.uint32(codes[3].only << 24 | codes[1].only << 16 | codes[2].only)
    out = np.empty(total, dtype=np.uint32)
    if green.only is not None and green.only < 256:
        out[:] = green.only
        return out << np.uint32(8) | rest
    raw = np.frombuffer(bits.data, dtype=np.uint8)
    at, i = bits.at, 0
    base = stop = -1  # the bits that the tables below are of: from base, `stop` of them
    while i < total:
        if not base <= at < base + stop:
            base = at & ~7
            n = min(WINDOW, bits.end - base) >> 3
            if n <= 0:
                raise WebpError("the data end too early")
            bytes_ = raw[base >> 3 : (base >> 3) + n + 2].astype(np.uint32)
            word = bytes_[:n] | bytes_[1 : n + 1] << np.uint32(8) | bytes_[2 : n + 2] << np.uint32(16)
            window = np.empty(8 * n, dtype=np.uint32)
            for r in range(8):
                window[r::8] = (word >> np.uint32(r)) & np.uint32((1 << green.width) - 1)
            # where the next code begins if one begins here; a back-reference, like the end, leads to `stop`, which leads to itself
            stop = 8 * n
            step = np.where(green.symbols < 256, green.lengths, stop)
            follow = np.append(np.minimum(step[window] + np.arange(stop), stop), stop)
            second = follow[follow]
            jump = second[second].data
        here, quarter = at - base, []
        add = quarter.append
        while here < stop:
            add(here)
            here = jump[here]
        first = np.array(quarter, dtype=np.int64)
        third = second[first]
        chain = np.stack([first, follow[first], third, follow[third]], axis=1).ravel()
        chain = chain[: np.searchsorted(chain, stop)][: total - i]
        symbols = green.symbols[window[chain]]
        last = int(symbols[-1])
        literals = len(chain) - int(last >= 256)
        out[i : i + literals] = symbols[:literals]
        i += literals
        at = base + int(chain[-1]) + int(green.lengths[window[chain[-1]]])
        if at > bits.end:
            raise WebpError("the data end too early")
        if last < 256:
            continue
        if last >= 280:
            raise WebpError("a cached colour without a cache")
        bits.at = at
        length = bits.value(last - 256)
        back = _distance(bits, distance, width)
        if back > i or i + length > total:
            raise WebpError("a back-reference leaves the image")
        out[i : i + length] = np.resize(out[i - back : i], length) if back < length else out[i - back : i - back + length]
        i += length
        at = bits.at
    bits.at = at
    return out << np.uint32(8) | rest


def channels(pixels: np.ndarray) -> np.ndarray:
    """The four bytes of each pixel (A, R, G, B) on a new last axis."""
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def joined(argb: np.ndarray) -> np.ndarray:
    a, r, g, b = (argb[..., i].astype(np.uint32) & np.uint32(255) for i in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _add_up(pixels: np.ndarray) -> np.ndarray:
    return joined(np.cumsum(channels(pixels), axis=0) & 255)


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The prediction of a pixel, or of many, from its neighbours' bytes."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), top.shape)
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode < 10:
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(axis=-1, keepdims=True), np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    half = mean(left, top)
    return np.clip(half + np.trunc((half - top_left) / 2).astype(np.int64), 0, 255)


def _undo_predictor(pixels: np.ndarray, width: int, size: int, blocks: np.ndarray) -> np.ndarray:
    c, modes = channels(pixels), (blocks >> np.uint32(8)) & np.uint32(15)
    c[0, 0] += (255, 0, 0, 0)
    c[0] = np.cumsum(c[0], axis=0) & 255  # the top row is predicted from the left
    for y in range(1, len(c)):
        c[y, 0] = (c[y, 0] + c[y - 1, 0]) & 255
        for x in range(1, width):
            top_right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
            c[y, x] = (c[y, x] + _predicted(int(modes[y >> size, x >> size]), c[y, x - 1], c[y - 1, x], top_right, c[y - 1, x - 1])) & 255
    return joined(c)


def _spread(blocks: np.ndarray, size: int, shape: tuple[int, int]) -> np.ndarray:
    return blocks.repeat(1 << size, axis=0).repeat(1 << size, axis=1)[: shape[0], : shape[1]]


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    signed = lambda x: (x & 255 ^ 128) - 128
    return (signed(factor) * signed(colour)) >> 5


def _undo_cross(pixels: np.ndarray, width: int, size: int, blocks: np.ndarray) -> np.ndarray:
    c, f = channels(pixels), channels(_spread(blocks, size, pixels.shape))
    c[..., 1] = (c[..., 1] + _delta(f[..., 3], c[..., 2])) & 255
    c[..., 3] = (c[..., 3] + _delta(f[..., 2], c[..., 2]) + _delta(f[..., 1], c[..., 1])) & 255
    return joined(c)


def _undo_green(pixels: np.ndarray, width: int, size: int, extra: None) -> np.ndarray:
    return _with_green(pixels, 1)


def _with_green(pixels: np.ndarray, times: int) -> np.ndarray:
    """Green added to red and blue, or (-1 times) taken away."""
    both = np.uint32(0xFF00FF)
    green = (pixels >> np.uint32(8) & np.uint32(255)) * np.uint32(0x10001)
    other = pixels & both
    return pixels & ~both | (other + green if times > 0 else (other | np.uint32(0x1000100)) - green) & both


def _undo_palette(pixels: np.ndarray, width: int, pack: int, colours: np.ndarray) -> np.ndarray:
    at = (pixels >> np.uint32(8)) & np.uint32(255)
    if pack:
        each = 8 >> pack
        shifts = np.arange(1 << pack, dtype=np.uint32) * np.uint32(each)
        at = ((at[..., None] >> shifts) & np.uint32((1 << each) - 1)).reshape(len(at), -1)[:, :width]
    table = np.zeros(256, dtype=np.uint32)  # an index beyond the palette is transparent black
    table[: len(colours)] = colours
    return table[at]


# -- encoding ---------------------------------------------------------------------------------------------------------


class Writer:
    """Gathers values with their numbers of bits; packs them lowest bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[int] = []
        self.few_sizes: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.few.append(value)
        self.few_sizes.append(bits)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.few:
            self.values.append(np.array(self.few, np.int64))
            self.sizes.append(np.array(self.few_sizes, np.int64))
            self.few, self.few_sizes = [], []
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, sizes = np.concatenate(self.values).astype(np.uint64), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        shifted = values << (starts & 31).astype(np.uint64)
        word = starts >> 5
        n = int(ends[-1] >> 5) + 2
        low = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(word + 1, (shifted >> np.uint64(32)).astype(np.float64), n)
        return (low + high).astype(np.uint32).astype("<u4").tobytes()[: (int(ends[-1]) + 7) // 8]


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and extra bits of lengths or distance codes from 1."""
    v = np.asarray(values, dtype=np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = (v >> np.maximum(top - 1, 0)) & 1
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + second), extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


def _put_single(w: Writer, *symbols: int) -> None:
    """A code of one or two symbols, by their names alone."""
    w.put(1 | (len(symbols) - 1) << 1 | 4, 3)
    for s in symbols:
        w.put(s, 8)


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        _put_single(w, *(used.tolist() or [0]))
        return
    tokens: list[tuple[int, int, int]] = []
    last, at = int(used[-1]) + 1, 0
    plain = lengths.tolist()
    while at < last:
        if plain[at]:
            tokens.append((plain[at], 0, 0))
            at += 1
            continue
        run = 1
        while at + run < last and not plain[at + run] and run < 138:
            run += 1
        tokens += [(18, run - 11, 7)] if run > 10 else [(17, run - 3, 3)] if run > 2 else [(0, 0, 0)] * run
        at += run
    symbols = np.array([t[0] for t in tokens])
    own = code_lengths(np.bincount(symbols, minlength=19), 7)
    words = codewords(own)
    if np.count_nonzero(own) == 1:
        bits = np.zeros(19, np.int64)
    else:
        bits = own
    n = max(i for i, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    w.put(0, 1)
    w.put(max(n, 4) - 4, 4)
    listed = own[list(LENGTH_ORDER)].tolist()[: max(n, 4)]
    for k in range(0, len(listed), 10):
        w.put(sum(x << 3 * i for i, x in enumerate(listed[k : k + 10])), 3 * len(listed[k : k + 10]))
    w.put(1, 1)
    count, size = len(tokens) - 2, 0  # a code with more than two symbols has more than two tokens
    while count >> (2 + 2 * size):
        size += 1
    w.put(size, 3)
    w.put(count, 2 + 2 * size)
    words, bits = words.tolist(), bits.tolist()
    w.few += [words[s] | extra << bits[s] for s, extra, _ in tokens]
    w.few_sizes += [bits[s] + k for s, _, k in tokens]


_NOTHING = np.zeros(280 + (1 << 11), dtype=np.int64)


def _put_image(w: Writer, pixels: np.ndarray, main: bool, copies: Sequence[tuple[int, int, int]] = (), cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None) -> None:
    """An entropy-coded image. copies: (pixel, length, distance) in order; groups: block bits and each block's group."""
    flat, width = pixels.ravel(), pixels.shape[1]
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            w.put(groups[0] - 2, 3)
            _put_image(w, groups[1].astype(np.uint32) << np.uint32(8), False)
    start, length, back = np.array(copies, dtype=np.int64).reshape(-1, 3).T
    literal = np.arange(len(flat))
    if len(start):
        edge = np.zeros(len(flat) + 1, dtype=np.int64)
        edge[start] += 1
        np.add.at(edge, start + length, -1)
        literal = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    argb = flat[literal]
    green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    rest = int(flat[0]) & 0xFFFF00FF
    if groups is None and not cache_bits and len(literal) and not ((argb ^ np.uint32(rest)) & np.uint32(0xFFFF00FF)).any():
        _put_green(w, literal, green, rest, start, length, back)
        return
    red, blue, alpha = ((argb >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24))
    if cache_bits:
        green = _cached(flat, literal, green, cache_bits)
    if len(start):
        (ls, le, lx), (ds, de, dx) = prefix_of(length), prefix_of(np.where(back == 1, 2, back + len(NEAR)))
    else:
        ls = ds = start
    own = np.zeros(len(literal), np.int64) if groups is None else groups[1][literal // width >> groups[0], literal % width >> groups[0]].astype(np.int64)
    copy_own = np.zeros(len(start), np.int64) if groups is None else groups[1][start // width >> groups[0], start % width >> groups[0]].astype(np.int64)
    n = 1 if groups is None else int(groups[1].max()) + 1
    real = green < 256 if cache_bits else slice(None)
    streams = ((green, own, 280 + (1 << cache_bits if cache_bits else 0)), (red[real], own[real], 256), (blue[real], own[real], 256), (alpha[real], own[real], 256), (ds, copy_own, 40))
    words, sizes = [], []
    for g in range(n):
        for k, (symbols, of, alphabet) in enumerate(streams):
            counts = np.bincount(symbols[of == g] if n > 1 else symbols, minlength=alphabet)
            if k == 0 and len(ls):
                counts = counts + np.bincount(256 + (ls[copy_own == g] if n > 1 else ls), minlength=alphabet)
            lengths = code_lengths(counts)
            _put_code(w, lengths)
            single = np.count_nonzero(counts) < 2
            words.append(_NOTHING[:alphabet] if single else codewords(lengths))
            sizes.append(_NOTHING[:alphabet] if single else lengths)
    # every literal and every copy writes some values, which go out in the order of their first pixels
    values, bits, order = [], [], []
    for j in ((0,) if all(not np.any(sizes[5 * g + k]) for g in range(n) for k in (1, 2, 3)) else range(4)):
        symbols = (green, red, blue, alpha)[j]
        keep = slice(None) if j == 0 else real
        if n == 1:
            values.append(words[j][symbols[keep]])
            bits.append(sizes[j][symbols[keep]])
        else:
            size = max(map(len, words))
            table = np.zeros((2, n, size), np.int64)
            for g in range(n):
                table[0, g, : len(words[5 * g + j])], table[1, g, : len(words[5 * g + j])] = words[5 * g + j], sizes[5 * g + j]
            values.append(table[0, own[keep], symbols[keep]])
            bits.append(table[1, own[keep], symbols[keep]])
        order.append(literal[keep] * 8 + j)
    if len(start):
        code = lambda k, s: (np.array([words[5 * g + k][x] for g, x in zip(copy_own, s, strict=True)]), np.array([sizes[5 * g + k][x] for g, x in zip(copy_own, s, strict=True)]))
        for j, (v, b) in enumerate((code(0, 256 + ls), (lx, le), code(4, ds), (dx, de))):
            values.append(v)
            bits.append(b)
            order.append(start * 8 + j)
    if len(values) == 1:
        w.many(values[0], bits[0])
        return
    by = np.argsort(np.concatenate(order), kind="stable")
    w.many(np.concatenate(values)[by], np.concatenate(bits)[by])


def _put_green(w: Writer, literal: np.ndarray, green: np.ndarray, rest: int, start: np.ndarray, length: np.ndarray, back: np.ndarray) -> None:
    """The codes and symbols of an image in which only green varies: the other channels' codes have one symbol."""
    counts, ds = np.bincount(green, minlength=280), start
    if len(start):
        (ls, le, lx), (ds, de, dx) = prefix_of(length), prefix_of(np.where(back == 1, 2, back + len(NEAR)))
        counts = counts + np.bincount(256 + ls, minlength=280)
    lengths, far = code_lengths(counts), code_lengths(np.bincount(ds, minlength=40))
    _put_code(w, lengths)
    for shift in (16, 0, 24):
        _put_single(w, rest >> shift & 255)
    _put_code(w, far)
    words, sizes = (codewords(lengths), lengths) if np.count_nonzero(counts) > 1 else (_NOTHING, _NOTHING)
    values, bits = words[green], sizes[green]
    if len(start):
        far_words, far_sizes = (codewords(far), far) if np.count_nonzero(far) > 1 else (_NOTHING, _NOTHING)
        at = np.repeat(np.searchsorted(literal, start), 4)
        values = np.insert(values, at, np.stack([words[256 + ls], lx, far_words[ds], dx], axis=1).ravel())
        bits = np.insert(bits, at, np.stack([sizes[256 + ls], le, far_sizes[ds], de], axis=1).ravel())
    w.many(values, bits)


def _cached(flat: np.ndarray, literal: np.ndarray, green: np.ndarray, bits: int) -> np.ndarray:
    """green, with 280 + place for literals that the colour cache holds."""
    cache, out, at = [None] * (1 << bits), green.copy(), dict(zip(literal.tolist(), range(len(literal)), strict=True))
    for i, p in enumerate(flat.tolist()):
        k = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - bits)
        if i in at and cache[k] == p:
            out[at[i]] = 280 + k
        cache[k] = p
    return out


def _differences(colours: np.ndarray) -> np.ndarray:
    c = channels(colours)
    return joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255)


def encode(pixels: np.ndarray, transforms: Sequence[int] = (), copies: Sequence[tuple[int, int, int]] = (), cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None, blocks: dict[int, tuple[int, np.ndarray]] | None = None) -> bytes:
    """An image file of ARGB pixels, height x width.

    transforms are applied in order; blocks has block bits and block image of the predictor (mode in green) and of
    cross-colour. copies are back-references in the transformed image, none over another.
    """
    height, width = pixels.shape
    if max(height, width) > MAX_SIDE:
        raise ValueError(f"at most {MAX_SIDE} pixels a side")
    w = Writer()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(bool((pixels >> np.uint32(24) != 255).any())), 1), (0, 3)):
        w.put(value, bits)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == GREEN:
            pixels = _with_green(pixels, -1)
        elif kind == PALETTE:
            colours, at = _colours(pixels)
            if len(colours) > 256:
                raise ValueError("a palette has 256 colours at most")
            w.put(len(colours) - 1, 8)
            _put_image(w, _differences(colours)[None, :], False)
            pixels = _packed(at.reshape(pixels.shape).astype(np.uint32), len(colours))
        else:
            size, image = blocks[kind]
            w.put(size - 2, 3)
            _put_image(w, image.astype(np.uint32), False)
            pixels = (_do_predictor if kind == PREDICTOR else _do_cross)(pixels, size, image.astype(np.uint32))
    w.put(0, 1)
    _put_image(w, pixels, True, copies, cache_bits, groups)
    return _file(w.bytes())


def _file(body: bytes) -> bytes:
    size = len(body)
    body += b"\0" * (size % 2)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body


def _colours(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pixels in order, and each one's place among them."""
    rest = pixels.flat[0] & np.uint32(0xFFFF00FF)
    if (pixels & np.uint32(0xFFFF00FF) != rest).any():
        return np.unique(pixels, return_inverse=True)
    green = (pixels >> np.uint32(8) & np.uint32(255)).ravel()
    there = np.bincount(green, minlength=256) > 0
    return there.nonzero()[0].astype(np.uint32) << np.uint32(8) | rest, (np.cumsum(there) - 1)[green]


def _packed(at: np.ndarray, n: int) -> np.ndarray:
    """Palette indices in the green byte, several to a pixel if there are few colours."""
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    if pack:
        full = np.pad(at, ((0, 0), (0, -at.shape[1] % (1 << pack)))).reshape(len(at), -1, 1 << pack)
        at = (full << (np.arange(1 << pack, dtype=np.uint32) * np.uint32(8 >> pack))).sum(axis=2, dtype=np.uint32)
    return at << np.uint32(8) | np.uint32(0xFF000000)


def _do_predictor(pixels: np.ndarray, size: int, blocks: np.ndarray) -> np.ndarray:
    c, modes = channels(pixels), (blocks >> np.uint32(8)) & np.uint32(15)
    guess = np.zeros_like(c)
    guess[0, 0] = (255, 0, 0, 0)
    guess[0, 1:], guess[1:, 0] = c[0, :-1], c[:-1, 0]
    for y in range(1, len(c)):
        for x in range(1, c.shape[1]):
            top_right = c[y - 1, x + 1] if x + 1 < c.shape[1] else c[y, 0]
            guess[y, x] = _predicted(int(modes[y >> size, x >> size]), c[y, x - 1], c[y - 1, x], top_right, c[y - 1, x - 1])
    return joined((c - guess) & 255)


def _do_cross(pixels: np.ndarray, size: int, blocks: np.ndarray) -> np.ndarray:
    c, f = channels(pixels), channels(_spread(blocks, size, pixels.shape))
    red = c[..., 1].copy()
    c[..., 1] -= _delta(f[..., 3], c[..., 2])
    c[..., 3] -= _delta(f[..., 2], c[..., 2]) + _delta(f[..., 1], red)
    return joined(c & 255)
