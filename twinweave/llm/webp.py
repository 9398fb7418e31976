"""Lossless WebP: a full decoder of the VP8L bit stream, and an encoder to store byte payloads (operator 1).

Decoder (``decode``): prefix codes (simple and normal), back-references with the two-dimensional distance
codes, colour cache, meta prefix groups, and the inverse of the predictor, cross-colour, subtract-green and
palette transforms, into an array of ARGB pixels. Where every pixel is one prefix symbol (red, blue and alpha
constant), symbols are found by numpy: the code length at every bit position, then four symbols a step.

Encoder (``encode_payloads``): a payload is a gray image, 64 pixels wide (wider beyond 16,384 rows), stored
with subtract-green, or with a palette where at most 16 values occur, length-limited prefix codes and
back-references for repeats of 32 bytes or more. ``encode_image`` writes any ARGB image with chosen
transforms, cache and prefix groups.

Defined results: a null or empty text is stored as 64 zero bytes; equal texts give equal bytes; a text beyond
268 million bytes (the format's largest image) is stored as several files, one after another.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import arrow_schema, slices, span_hashes, text_bytes

#: The order in which lengths of the code length code are stored.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values: (x, y) of the distance codes 1 to 120.
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_CACHE_HASH = 0x1E35A7BD
_LIMIT = 12  # longest code that the encoder writes
_BLACK = 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


# ---------------------------------------------------------------- bits and prefix codes


class BitReader:
    def __init__(self, data: bytes):
        self.data = bytes(data) + bytes(16)
        self.pos = 0

    def read(self, n: int) -> int:
        at = self.pos
        self.pos = at + n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


class BitWriter:
    """Bits from the lowest on, kept in one integer."""

    def __init__(self):
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


_turns: dict[int, np.ndarray] = {}


def _turned(bits: int) -> np.ndarray:
    """Every number of so many bits, reversed."""
    if bits not in _turns:
        x = np.arange(1 << bits)
        out = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            out |= ((x >> i) & 1) << (bits - 1 - i)
        _turns[bits] = out
    return _turns[bits]


def _reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes as they stand in the stream (first bit lowest); 0 for unused symbols."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used):
        n = lengths[used]
        order = np.argsort(n, kind="stable")
        bits = int(n.max())
        width = 1 << (bits - n[order])
        # codes start where the ones before them end, as windows of ``bits`` bits
        out[used[order]] = _turned(bits)[np.cumsum(width) - width]
    return out


class PrefixTable:
    """symbol and length by the next ``bits`` bits; a code of one symbol has length 0."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else -1
        if len(used) <= 1:
            self.bits = 0
            self.symbol = np.array([max(self.only, 0)], np.int64)
            self.length = np.zeros(1, np.uint8)
            return
        n = lengths[used].astype(np.int64)
        self.bits = bits = int(n.max())
        if int((1 << (bits - n)).sum()) != 1 << bits:
            raise ValueError("prefix code is not complete")
        # in canonical order codes fill the table of unreversed windows one after another
        order = np.lexsort((used, n))
        self.symbol = np.empty(1 << bits, np.int64)
        self.length = np.empty(1 << bits, np.uint8)
        turn = _turned(bits)
        width = 1 << (bits - n[order])
        self.symbol[turn] = np.repeat(used[order], width)
        self.length[turn] = np.repeat(n[order], width)

    def read(self, reader: BitReader) -> int:
        if not self.bits:
            return int(self.symbol[0])
        at = reader.pos
        window = (int.from_bytes(reader.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & ((1 << self.bits) - 1)
        reader.pos = at + int(self.length[window])
        return int(self.symbol[window])


def read_code(reader: BitReader, alphabet: int) -> PrefixTable:
    read = reader.read
    lengths = np.zeros(alphabet, np.int64)
    if read(1):
        two = read(1)
        first = read(8 if read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[read(8)] = 1
        return PrefixTable(lengths)
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + read(4)):
        of_lengths[_LENGTH_ORDER[i]] = read(3)
    table = PrefixTable(of_lengths)
    symbol, size, bits = table.symbol.tolist(), table.length.tolist(), table.bits
    most = 2 + read(2 + 2 * read(3)) if read(1) else alphabet
    mask = (1 << bits) - 1
    data, pos = reader.data, reader.pos
    at, before = 0, 8
    held = int.from_bytes(data[pos >> 3 : (pos >> 3) + 400], "little") >> (pos & 7)
    taken = 0
    while at < alphabet and most > 0:
        most -= 1
        if taken > 3000:
            pos += taken
            held = int.from_bytes(data[pos >> 3 : (pos >> 3) + 400], "little") >> (pos & 7)
            taken = 0
        window = (held >> taken) & 0xFFFFF
        s = symbol[window & mask]
        n = size[window & mask]
        if s < 16:
            if s:
                lengths[at] = before = s
            at += 1
        elif s == 16:
            k = 3 + (window >> n & 3)
            n += 2
            lengths[at : at + k] = before
            at += k
        elif s == 17:
            at += 3 + (window >> n & 7)
            n += 3
        else:
            at += 11 + (window >> n & 127)
            n += 7
        taken += n
    reader.pos = pos + taken
    return PrefixTable(lengths)


def _extra(code: int, read) -> int:
    """The value of a length or distance prefix."""
    if code < 4:
        return code + 1
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


# ---------------------------------------------------------------- decoder


def _read_pixels(reader: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels (uint32) of an entropy-coded image, before any transform is inverted."""
    read = reader.read
    cache_bits = read(4) if read(1) else 0
    groups, group_of, meta_bits, meta_width = 1, None, 0, 0
    if main and read(1):
        meta_bits = read(3) + 2
        meta_width = -(-width >> meta_bits)
        group_of = (_read_pixels(reader, meta_width, -(-height >> meta_bits), False) >> 8) & 0xFFFF
        groups = int(group_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [tuple(read_code(reader, n) for n in (280 + cache_size, 256, 256, 256, 40)) for _ in range(groups)]
    if groups == 1 and not cache_bits and all(not c.bits for c in codes[0][1:4]):
        return _read_plain(reader, width, width * height, codes[0])
    total = width * height
    out = [0] * total
    cache = [0] * cache_size
    shift = 32 - cache_bits
    at = filled = 0
    green, red, blue, alpha, far = codes[0]
    while at < total:
        if group_of is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[int(group_of[(y >> meta_bits) * meta_width + (x >> meta_bits)])]
        s = green.read(reader)
        if s < 256:
            r = red.read(reader)
            b = blue.read(reader)
            out[at] = alpha.read(reader) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _extra(s - 256, read)
            back = _distance(_extra(far.read(reader), read), width)
            if back > at:
                raise ValueError("back-reference before the image")
            for i in range(at, min(at + n, total)):
                out[i] = out[i - back]
            at = min(at + n, total)
        else:
            for p in out[filled:at]:
                cache[(p * _CACHE_HASH & 0xFFFFFFFF) >> shift] = p
            filled = at
            out[at] = cache[s - 280]
            at += 1
        if cache_bits and at - filled > 64:
            for p in out[filled:at]:
                cache[(p * _CACHE_HASH & 0xFFFFFFFF) >> shift] = p
            filled = at
    return np.array(out, np.uint32)


def _read_plain(reader: BitReader, width: int, total: int, codes) -> np.ndarray:
    """The same where only green (with back-references) varies."""
    green, red, blue, alpha, far = codes
    rest = np.uint32(int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0]))
    if not green.bits:
        return np.full(total, rest | np.uint32(int(green.symbol[0]) << 8), np.uint32)
    first = reader.pos >> 3
    data = np.frombuffer(reader.data, np.uint8)[first:].astype(np.uint32)
    windows = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    n = len(windows)
    mask = np.uint32((1 << green.bits) - 1)
    plain = np.where(green.symbol < 256, green.length, 0).astype(np.uint8)  # 0 stops a run of literals
    one = np.empty((n, 8), np.uint8)
    for s in range(8):
        one[:, s] = plain[(windows >> np.uint32(s)) & mask]
    one = np.concatenate([one.reshape(-1), np.zeros(64, np.uint8)])
    size = n * 8
    place = np.arange(size, dtype=np.int32)
    step = one[place + one[:size]]
    two = np.where((one[:size] > 0) & (step > 0), one[:size] + step, 0).astype(np.uint8)
    two = np.concatenate([two, np.zeros(64, np.uint8)])
    step = two[place + two[:size]]
    four = np.where((two[:size] > 0) & (step > 0), two[:size] + step, 0).astype(np.uint8).tobytes()
    single = one[:size].tobytes()
    symbols, lengths, bits = green.symbol, green.length, green.bits
    runs: list[int] = []  # positions: four symbols from p on, or one at -1 - p
    add = runs.append
    copies: list[tuple[int, int, int]] = []  # (entries of runs before it, length, distance)
    p, made, counted = reader.pos - 8 * first, 0, 0
    while True:
        while p < size and (k := four[p]):
            add(p)
            p += k
        made += 4 * (len(runs) - counted)
        counted = len(runs)
        if made >= total or p >= size:
            break
        if k := single[p]:
            add(-1 - p)
            p += k
            made += 1
            counted += 1
            continue
        window = int(windows[p >> 3]) >> (p & 7) & ((1 << bits) - 1)
        reader.pos = 8 * first + p + int(lengths[window])
        length = _extra(int(symbols[window]) - 256, reader.read)
        copies.append((counted, length, _distance(_extra(far.read(reader), reader.read), width)))
        made += length
        p = reader.pos - 8 * first
    at = np.array(runs, np.int64)
    quad = at >= 0
    start = np.where(quad, at, -1 - at)
    count = np.where(quad, 4, 1)
    head = np.concatenate([[0], np.cumsum(count)])
    where = np.zeros(head[-1], np.int64)
    where[head[:-1]] = start
    q, h = start[quad], head[:-1][quad]
    where[h + 1] = q + one[q]
    half = q + two[q]
    where[h + 2] = half
    where[h + 3] = half + one[half]
    literal = symbols[(windows[where >> 3] >> (where & 7).astype(np.uint32)) & mask].astype(np.uint8)
    if copies:
        out = np.zeros(total, np.uint8)
        done = used = 0
        for entries, length, back in [*copies, (len(runs), 0, 1)]:
            k = min(int(head[entries]) - used, total - done)
            if k:
                last = int(where[used + k - 1])
                end = last + int(one[last])
            out[done : done + k] = literal[used : used + k]
            done, used = done + k, used + k
            length = min(length, total - done)
            if length and back > done:
                raise ValueError("back-reference before the image")
            while length > 0:  # a copy may overlap what it makes
                piece = min(length, back)
                out[done : done + piece] = out[done - back : done - back + piece]
                done, length = done + piece, length - piece
                back *= 2
        if done < total:
            raise ValueError("image data ends early")
        if k:  # else the last copy has left the reader where it must be
            reader.pos = 8 * first + end
    else:
        out = literal[:total]
        if len(out) < total:
            raise ValueError("image data ends early")
        reader.pos = 8 * first + int(where[total - 1]) + int(one[where[total - 1]])
    return rest | out.astype(np.uint32) << np.uint32(8)


def _split(argb: np.ndarray) -> np.ndarray:
    """Channels alpha, red, green, blue as the last axis."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _join(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predict(mode: int, left, top, corner, right):
    """Prediction from neighbours (channel arrays) by mode; ``right`` is above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode == 6:
        return (left + corner) >> 1
    if mode == 7:
        return (left + top) >> 1
    if mode == 8:
        return (corner + top) >> 1
    if mode == 9:
        return (top + right) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:
        toward_left = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(toward_left, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = (left + top) >> 1
        d = half - corner
        return np.clip(half + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    return np.zeros_like(left) + np.array([255, 0, 0, 0], np.int32)


_BY_TOP = {0, 2, 3, 4, 8, 9, 14, 15}  # modes that do not look left


def _undo_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    rest = _split(image)
    h, w = image.shape
    out = np.zeros_like(rest)
    out[0, 0] = rest[0, 0] + np.array([255, 0, 0, 0])
    out[0] = np.cumsum(np.concatenate([out[0, :1], rest[0, 1:]]), axis=0)
    out[0] &= 255
    for y in range(1, h):
        above = out[y - 1]
        out[y, 0] = (rest[y, 0] + above[0]) & 255
        x = 1
        row_modes = modes[y >> bits]
        while x < w:
            mode = int(row_modes[x >> bits])
            end = min(w, ((x >> bits) + 1) << bits)
            if mode == 1:
                out[y, x:end] = (out[y, x - 1] + np.cumsum(rest[y, x:end], axis=0)) & 255
            elif mode in _BY_TOP:
                wrapped = above[x + 1 : end + 1] if end < w else np.concatenate([above[x + 1 :], out[y, :1]])
                out[y, x:end] = (rest[y, x:end] + _predict(mode, above[x:end], above[x:end], above[x - 1 : end - 1], wrapped)) & 255
            else:
                for i in range(x, end):
                    right = above[i + 1] if i + 1 < w else out[y, 0]
                    out[y, i] = (rest[y, i] + _predict(mode, out[y, i - 1], above[i], above[i - 1], right)) & 255
            x = end
    return _join(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(image: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Add (sign 1, decoding) or subtract (sign -1) the colour deltas."""
    h, w = image.shape
    c = _split(image)
    e = _split(elements)[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    to_blue_of_red, to_blue_of_green, to_red = (_signed(e[..., i]) for i in (1, 2, 3))
    red = c[..., 1]
    changed = red + sign * ((to_red * _signed(c[..., 2])) >> 5)
    known = changed if sign > 0 else red  # the true red in either direction
    c[..., 3] += sign * ((to_blue_of_green * _signed(c[..., 2])) >> 5) + sign * ((to_blue_of_red * _signed(known)) >> 5)
    c[..., 1] = changed
    return _join(c)


def _green(image: np.ndarray, sign: int) -> np.ndarray:
    c = _split(image)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return _join(c)


def _palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(image: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    bits = _palette_bits(len(colours))
    index = (image >> np.uint32(8)) & np.uint32(255)
    if bits:
        depth = 8 >> bits
        shifts = (np.arange(1 << bits) * depth).astype(np.uint32)
        index = ((index[:, :, None] >> shifts) & np.uint32((1 << depth) - 1)).reshape(image.shape[0], -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels, uint32 of shape (height, width), of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    reader = BitReader(data[21 : 20 + size])
    width, height = reader.read(14) + 1, reader.read(14) + 1
    reader.read(1)
    if reader.read(3):
        raise ValueError("unknown version")
    transforms = []
    w = width
    while reader.read(1):
        kind = reader.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = reader.read(3) + 2
            bw, bh = -(-w >> bits), -(-height >> bits)
            transforms.append((kind, w, bits, _read_pixels(reader, bw, bh, False).reshape(bh, bw)))
        elif kind == PALETTE:
            n = reader.read(8) + 1
            deltas = _split(_read_pixels(reader, n, 1, False))
            transforms.append((kind, w, 0, _join(np.cumsum(deltas, axis=0))))
            w = -(-w >> _palette_bits(n))
        else:
            transforms.append((kind, w, 0, None))
    image = _read_pixels(reader, w, height, True).reshape(height, w)
    for kind, w, bits, held in reversed(transforms):
        if kind == PREDICTOR:
            image = _undo_predictor(image, (held >> np.uint32(8)) & np.uint32(15), bits)
        elif kind == CROSS_COLOUR:
            image = _cross(image, held, bits, 1)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, 1)
        else:
            image = _undo_palette(image, held, w)
    return image


# ---------------------------------------------------------------- encoder


def code_lengths(counts: np.ndarray, limit: int = _LIMIT) -> np.ndarray:
    """Prefix code lengths of at most ``limit`` for symbols that occur; one symbol alone gets length 1."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    least = 1
    while True:
        order = np.argsort(np.maximum(weight, least), kind="stable")
        lengths = _two_queues(np.maximum(weight, least)[order].tolist())
        if max(lengths) <= limit:
            out[used[order]] = lengths
            return out
        least = max(2 * least, int(weight.sum()) >> (limit + 2))


def _two_queues(weight: list[int]) -> list[int]:
    """Code lengths of sorted weights: leaves in one queue, made nodes, which come in order, in another."""
    n = len(weight)
    made: list[int] = []
    parent = [0] * (2 * n - 1)
    i = j = 0
    for k in range(n - 1):
        total = 0
        for _ in range(2):
            if i < n and (j >= k or weight[i] <= made[j]):
                total += weight[i]
                parent[i] = n + k
                i += 1
            else:
                total += made[j]
                parent[n + j] = n + k
                j += 1
        made.append(total)
    depth = [0] * (2 * n - 1)
    for x in range(2 * n - 3, -1, -1):
        depth[x] = depth[parent[x]] + 1
    return depth[:n]


def _write_code(out: BitWriter, lengths: np.ndarray) -> None:
    """A prefix code: simple if it has one symbol, or two below 256; else with four bits for each length."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256) or len(used) == 2 and used[1] < 256:
        first = used[0] if used else 0
        out.write(1 | (len(used) == 2) << 1 | (first > 1) << 2 | first << 3, 11 if first > 1 else 4)
        if len(used) == 2:
            out.write(used[1], 8)
        return
    # the code length code: 0 to 12 and 16 to 18 in four bits each
    value, size = 15 << 1, 5
    for k in _LENGTH_ORDER:
        value |= (0 if 13 <= k <= 15 else 4) << size
        size += 3
    size += 1  # lengths for the whole alphabet follow
    at = 0
    bits = _LENGTH_CODE
    for s in [*used, len(lengths)]:
        gap = s - at
        while gap > 0:
            if gap >= 11:
                k = min(gap, 138)
                value |= (bits[18] | (k - 11) << 4) << size
                size += 11
            elif gap >= 3:
                k = gap
                value |= (bits[17] | (k - 3) << 4) << size
                size += 7
            else:
                k = 1
                value |= bits[0] << size
                size += 4
            gap -= k
        if s < len(lengths):
            value |= bits[int(lengths[s])] << size
            size += 4
        at = s + 1
    out.write(value, size)


_LENGTH_CODE = _reversed_codes(np.array([4] * 13 + [0] * 3 + [4] * 3)).tolist()


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def _container(body: bytes) -> bytes:
    size = len(body) + 1
    pad = size & 1
    return b"RIFF" + (12 + size + pad).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + b"\x2f" + body + b"\0" * pad


def _header(width: int, height: int) -> BitWriter:
    if max(width, height) > 16384:
        raise ValueError("image too large for the format")
    out = BitWriter()
    out.write(width - 1 | (height - 1) << 14 | 1 << 28, 32)
    return out


def _write_image(out: BitWriter, argb: np.ndarray, main: bool, cache_bits: int = 0, meta_bits: int = 0) -> None:
    """An entropy-coded image: greedy runs as back-references, cache hits, prefix groups by block row and column."""
    h, w = argb.shape
    px = argb.reshape(-1).tolist()
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    tokens = []  # (position, green symbol, rest of the pixel or copy)
    last: dict[tuple, int] = {}
    at = 0
    while at < len(px):
        key = tuple(px[at : at + 3])
        back = at - last[key] if len(key) == 3 and key in last else 0
        n = 0
        while back and at + n < len(px) and px[at + n] == px[at + n - back] and n < 4096:
            n += 1
        slot = (px[at] * _CACHE_HASH & 0xFFFFFFFF) >> shift if cache_bits else 0
        if n >= 3:
            tokens.append((at, "copy", n, back))
        elif cache_bits and cache[slot] == px[at]:
            n = 1
            tokens.append((at, "cache", slot, 0))
        else:
            n = 1
            tokens.append((at, "pixel", px[at], 0))
        for i in range(at, at + n):
            last[tuple(px[i : i + 3])] = i
            if cache_bits:
                cache[(px[i] * _CACHE_HASH & 0xFFFFFFFF) >> shift] = px[i]
        at += n
    out.write(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    groups = 1
    group = lambda at: 0
    if main:
        if meta_bits:
            bw, bh = -(-w >> meta_bits), -(-h >> meta_bits)
            blocks = (np.arange(bw * bh, dtype=np.uint32) % 3).reshape(bh, bw)
            groups = int(blocks.max()) + 1
            out.write(1 | (meta_bits - 2) << 1, 4)
            _write_image(out, blocks << np.uint32(8), False)
            group = lambda at: int(blocks[(at // w) >> meta_bits, (at % w) >> meta_bits])
        else:
            out.write(0, 1)
    sizes = (280 + len(cache), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    plan = []
    for at, kind, a, b in tokens:
        g = group(at)
        if kind == "pixel":
            parts = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, 280 + a, 0, 0)]
        else:
            s, extra, n = _prefix(a)
            t, more, m = _prefix(_far_code(b, w))
            parts = [(0, 256 + s, extra, n), (4, t, more, m)]
        for c, s, _, _ in parts:
            counts[g][c][s] += 1
        plan.append((g, parts))
    lengths = [[code_lengths(c) for c in cs] for cs in counts]
    for ls in lengths:
        for x in ls:
            _write_code(out, x)
    codes = [[_reversed_codes(x) for x in ls] for ls in lengths]
    alone = [[np.count_nonzero(x) == 1 for x in ls] for ls in lengths]
    for g, parts in plan:
        for c, s, extra, n in parts:
            if not alone[g][c]:
                out.write(int(codes[g][c][s]), int(lengths[g][c][s]))
            out.write(extra, n)


def _far_code(back: int, width: int) -> int:
    """The smallest distance code of a distance."""
    return next((i + 1 for i, (x, y) in enumerate(_NEAR) if max(1, x + y * width) == back), back + 120)


def encode_image(argb: np.ndarray, transforms=(), cache_bits: int = 0, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of ARGB pixels (uint32, two-dimensional).

    ``transforms`` are applied in order: (PREDICTOR, bits, modes), (CROSS_COLOUR, bits, elements),
    (SUBTRACT_GREEN,), (PALETTE,).
    """
    image = argb.astype(np.uint32)
    out = _header(image.shape[1], image.shape[0])
    for kind, *more in transforms:
        out.write(1 | kind << 1, 3)
        if kind == PREDICTOR:
            bits, modes = more
            out.write(bits - 2, 3)
            _write_image(out, np.uint32(_BLACK) | modes.astype(np.uint32) << np.uint32(8), False)
            image = _residuals(image, modes, bits)
        elif kind == CROSS_COLOUR:
            bits, elements = more
            out.write(bits - 2, 3)
            _write_image(out, elements.astype(np.uint32), False)
            image = _cross(image, elements.astype(np.uint32), bits, -1)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, -1)
        else:
            colours, index = np.unique(image, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            out.write(len(colours) - 1, 8)
            c = _split(colours)
            _write_image(out, _join(np.diff(c, axis=0, prepend=0))[None, :], False)
            image = _bundle(index.reshape(image.shape), _palette_bits(len(colours)))
    out.write(0, 1)
    _write_image(out, image, True, cache_bits, meta_bits)
    return _container(out.value.to_bytes((out.size + 7) // 8, "little"))


def _bundle(index: np.ndarray, bits: int) -> np.ndarray:
    """Palette indexes as pixels, several in one green value where they are small."""
    per, depth = 1 << bits, 8 >> bits
    wide = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(index.shape[0], -1, per)
    green = (wide << (np.arange(per) * depth)).sum(-1).astype(np.uint32)
    return np.uint32(_BLACK) | green << np.uint32(8)


def _residuals(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    c = _split(image)
    h, w = image.shape
    out = np.zeros_like(c)
    for y in range(h):
        for x in range(w):
            if not y or not x:
                guess = c[y, x - 1] if x else c[y - 1, x] if y else np.array([255, 0, 0, 0])
            else:
                right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                guess = _predict(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right)
            out[y, x] = c[y, x] - guess
    return _join(out)


# ---------------------------------------------------------------- payloads in batches

_MATCH = 32
#: Bytes of the largest image.
MOST = 16384 * 16384


def shape_of(size: int) -> tuple[int, int]:
    """(width, height) of the image of a payload."""
    width = 64 * max(1, -(-size // (64 * 16384)))
    return width, -(-size // width)


def _repeats(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By row, (position, earlier position) of stretches of _MATCH bytes that also stand earlier at a multiple of _MATCH."""
    n = len(data) - _MATCH + 1
    if n <= 0:
        return {}
    start = np.arange(n)
    value = span_hashes(data, start, start + _MATCH)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    value ^= row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    source = start[(start - offsets[row]) % _MATCH == 0]
    source = source[source + _MATCH <= offsets[row[source] + 1]]
    slot = (value & np.uint64((1 << 22) - 1)).astype(np.int64)
    taken = np.zeros(1 << 22, np.uint8)
    np.add.at(taken, slot[source], 1)
    own = np.zeros(n, np.uint8)
    own[source] = 1
    hit = np.flatnonzero((taken[slot] > own) & (start + _MATCH <= offsets[row + 1]))
    if not len(hit):
        return {}
    order = np.argsort(value[source], kind="stable")
    keys, places = value[source][order], source[order]
    at = np.minimum(np.searchsorted(keys, value[hit]), len(keys) - 1)
    good = (keys[at] == value[hit]) & (places[at] < hit)
    out: dict[int, list[tuple[int, int]]] = {}
    for t, s in zip(hit[good].tolist(), places[at[good]].tolist(), strict=True):
        r = int(row[t])
        out.setdefault(r, []).append((t - int(offsets[r]), s - int(offsets[r])))
    return out


def _tokens_with_copies(payload: np.ndarray, repeats: list[tuple[int, int]], width: int):
    """(symbols, codes' extra bits, their numbers, kind) with greedy copies; kind 1 is a distance symbol."""
    symbols: list[np.ndarray] = []
    extras: list[np.ndarray] = []
    bits: list[np.ndarray] = []
    kinds: list[np.ndarray] = []

    def put(s, e, b, k):
        symbols.append(np.asarray(s, np.int64))
        extras.append(np.asarray(e, np.int64))
        bits.append(np.asarray(b, np.int64))
        kinds.append(np.asarray(k, np.int64))

    done, n = 0, len(payload)
    for t, s in repeats:
        if t < done:
            continue
        length = _MATCH
        while t + length < n and length < 4096:
            step = min(256, n - t - length, 4096 - length)
            same = payload[t + length : t + length + step] == payload[s + length : s + length + step]
            if same.all():
                length += step
            else:
                length += int(np.argmin(same))
                break
        if not np.array_equal(payload[t : t + _MATCH], payload[s : s + _MATCH]):
            continue
        k = t - done
        put(payload[done:t], np.zeros(k), np.zeros(k), np.zeros(k))
        a, x, m = _prefix(length)
        b, y, q = _prefix(_far_code(t - s, width))
        put([256 + a, b], [x, y], [m, q], [0, 1])
        done = t + length
    k = n - done
    put(payload[done:], np.zeros(k), np.zeros(k), np.zeros(k))
    return tuple(np.concatenate(x) for x in (symbols, extras, bits, kinds))


def _prologue(width: int, height: int, green: np.ndarray, far: np.ndarray) -> BitWriter:
    out = _header(width, height)
    out.write(1 | SUBTRACT_GREEN << 1, 3)
    out.write(0, 3)  # no more transforms, no cache, one prefix group
    _write_code(out, green)
    _write_code(out, _ZERO)
    _write_code(out, _ZERO)
    _write_code(out, _FULL)
    _write_code(out, far)
    return out


_ZERO = np.array([1] + [0] * 255)
_FULL = np.array([0] * 255 + [1])
_NO_FAR = np.array([1] + [0] * 39)


def _pack(start: np.ndarray, code: np.ndarray, size: np.ndarray, total_bits: int) -> np.ndarray:
    """Bytes in which each code stands at its bit; starts ascend and do not overlap."""
    words = np.zeros((total_bits >> 6) + 2, np.uint64)
    live = size > 0
    start, code, size = start[live], code[live].astype(np.uint64), size[live]
    if len(start):
        at, within = start >> 6, (start & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[first]] = np.bitwise_or.reduceat(code << within, first)
        over = np.flatnonzero((start & 63) + size > 64)
        words[at[over] + 1] |= code[over] >> (np.uint64(64) - within[over])
    return words.view(np.uint8)


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Lossless WebP files of the payloads in a buffer; every payload's size is a positive multiple of 64."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    counts = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256)
    repeats = _repeats(data, offsets)
    kinds = np.count_nonzero(counts, axis=1)
    out: list[bytes] = [b""] * rows
    plain = []
    for r in range(rows):
        payload = data[offsets[r] : offsets[r + 1]]
        width, height = shape_of(len(payload))
        if kinds[r] <= 16:
            gray = np.pad(payload, (0, width * height - len(payload))).astype(np.uint32).reshape(height, width)
            out[r] = _encode_few(gray)
        elif r in repeats or width * height != len(payload):
            payload = np.pad(payload, (0, width * height - len(payload)))
            symbols, extras, bits, which = _tokens_with_copies(payload, repeats.get(r, []), width)
            green = code_lengths(np.bincount(symbols[which == 0], minlength=280))
            far = code_lengths(np.bincount(symbols[which == 1], minlength=40))
            head = _prologue(width, height, green, far)
            n = np.where(which == 0, green[symbols], 0 if np.count_nonzero(far) <= 1 else far[np.minimum(symbols, 39)])
            code = np.where(which == 0, _reversed_codes(green)[symbols], 0 if np.count_nonzero(far) <= 1 else _reversed_codes(far)[np.minimum(symbols, 39)]) | extras << n
            n = n + bits
            start = head.size + np.cumsum(n) - n
            total = int(start[-1] + n[-1])
            body = _pack(start, code, n, total)[: (total + 7) // 8].copy()
            h = np.frombuffer(head.value.to_bytes((head.size + 7) // 8, "little"), np.uint8)
            body[: len(h)] |= h
            out[r] = _container(body.tobytes())
        else:
            plain.append(r)
    if plain:
        _encode_plain(data, offsets, counts, plain, out)
    return out


def _encode_plain(data, offsets, counts, plain: list[int], out: list[bytes]) -> None:
    """Payloads without copies, all at once."""
    codes = np.zeros((len(plain), 256), np.int64)
    lengths = np.zeros((len(plain), 256), np.int64)
    heads = []
    for i, r in enumerate(plain):
        green = code_lengths(np.concatenate([counts[r], np.zeros(24, np.int64)]))
        lengths[i] = green[:256]
        codes[i] = _reversed_codes(green)[:256]
        heads.append(_prologue(*shape_of(int(offsets[r + 1] - offsets[r])), green, _NO_FAR))
    sizes = np.array([offsets[r + 1] - offsets[r] for r in plain])
    body = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in plain])
    key = np.repeat(np.arange(len(plain)) * 256, sizes) + body
    n = lengths.reshape(-1)[key]
    code = codes.reshape(-1)[key]
    ends = np.cumsum(sizes)
    running = np.concatenate([[0], np.cumsum(n)])
    bits = running[ends] - running[ends - sizes]
    head_bits = np.array([h.size for h in heads])
    n_bytes = (head_bits + bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    start = running[:-1] + np.repeat(base[:-1] * 8 + head_bits - running[ends - sizes], sizes)
    packed = _pack(start, code, n, int(base[-1]) * 8)
    for i, r in enumerate(plain):
        part = packed[base[i] : base[i + 1]].copy()
        h = np.frombuffer(heads[i].value.to_bytes((heads[i].size + 7) // 8, "little"), np.uint8)
        part[: len(h)] |= h
        out[r] = _container(part.tobytes())


def _encode_few(gray: np.ndarray) -> bytes:
    """A payload of at most 16 values: palette, several pixels in a byte, runs as copies."""
    return encode_image(np.uint32(_BLACK) | gray << np.uint32(16) | gray << np.uint32(8) | gray, [(PALETTE,)])


def encode_parts(payload: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each row as one file, or as several, one after another, where it is larger than an image can be."""
    size = np.diff(at)
    pieces = np.maximum(1, -(-size // MOST))
    if (pieces == 1).all():
        return encode_payloads(payload, at)
    first = np.concatenate([[0], np.cumsum(pieces)])
    start = np.repeat(at[:-1], pieces) + (np.arange(first[-1]) - np.repeat(first[:-1], pieces)) * MOST
    files = encode_payloads(payload, np.append(start, at[-1]))
    return [b"".join(files[a:b]) for a, b in zip(first, first[1:], strict=False)]


def decode_parts(data: bytes) -> list[np.ndarray]:
    """The images of files that stand one after another."""
    out, at = [], 0
    while at < len(data) or not out:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        out.append(decode(data[at:end]))
        at = end
    return out


# ---------------------------------------------------------------- operator


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded by zero bytes to a positive multiple of 64."""
    size = np.diff(offsets)
    wide = np.maximum((size + 63) // 64 * 64, 64)
    at = np.concatenate([[0], np.cumsum(wide)])
    out = np.zeros(at[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], size)] = data
    return out, at


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): every text's bytes as a lossless WebP file."""
    ddl = "doc_id long,n_bytes long,payload_bytes long,media binary"

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(1))
                payload, at = padded(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(at)), pa.array(encode_parts(payload, at), pa.binary())], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def gray_features(image: np.ndarray) -> str:
    """Size, mean, spread, share of zeros, entropy in bits and mean step along rows of a gray image, as text."""
    counts = np.bincount(image.reshape(-1), minlength=256)
    total = counts.sum()
    level = np.arange(256)
    mean = float((counts * level).sum()) / total
    spread = max(0.0, float((counts * level * level).sum()) / total - mean * mean) ** 0.5
    p = counts[counts > 0] / total
    step = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum()) / total
    return f"{image.shape[1]}x{image.shape[0]} mean={mean:.3f} spread={spread:.3f} zero={counts[0] / total:.4f} entropy={-float((p * np.log2(p)).sum()):.4f} step={step:.3f}"


def read_back(media: DataFrame) -> DataFrame:
    """Decode stored media: digests of the payload that is read and features of the pixels."""
    ddl = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string"

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            rows = []
            for n, blob in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                grays = [(pixels >> np.uint32(8)).astype(np.uint8) for pixels in decode_parts(blob)]
                payload = b"".join([g.reshape(-1)[: n - k * MOST].tobytes() for k, g in enumerate(grays)])
                rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), "; ".join(map(gray_features, grays))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in rows], type=schema.field(k + 3).type) for k in range(5))], schema=schema)

    return media.mapInArrow(run, ddl)
