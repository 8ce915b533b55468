"""PKWARE's data compression library format ("implode"), from its published descriptions.

The decoder reads both literal modes; the encoder writes plain literals and greedy matches found by a hash of three bytes.
"""

from __future__ import annotations

from ..errors import CompressionError

# code lengths, as repetitions (upper four bits, less one) of a length (lower four bits)
_LITERALS = bytes(
    int(x)
    for x in (
        "11 124 8 7 28 7 188 13 76 4 10 8 12 10 12 10 8 23 8 9 7 6 7 8 7 6 55 8 23 24 12 11 7 9 11 12 6 7 22 5 7 24 6 11 9 6 7 22 7 11 38 7 9 8 25 11 8 11 9 12 8 12 5 38 5 38 5 11 7 5 6 21 6 10 53 8 7 24 "
        "10 27 44 253 253 253 252 252 252 13 12 45 12 45 12 61 12 45 44 173"
    ).split()
)
_LENGTHS, _DISTANCES = bytes([2, 35, 36, 53, 38, 23]), bytes([2, 20, 53, 230, 247, 151, 248])
_BASE = (3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264)
_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)
_END = 519


def _codes(packed: bytes) -> dict[int, tuple[int, int]]:
    """Symbol -> (bits in the order they are sent, first lowest; how many): canonical codes with all bits inverted."""
    lengths = [b & 15 for b in packed for _ in range((b >> 4) + 1)]
    out, code = {}, 0
    for size in range(1, 16):
        for symbol in (s for s, n in enumerate(lengths) if n == size):
            inverted = code ^ (1 << size) - 1
            out[symbol] = int(f"{inverted:0{size}b}"[::-1], 2), size
            code += 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, count: int) -> int:
        while self.n < count:
            if self.at >= len(self.data):
                raise CompressionError("imploded stream ends early")
            self.held |= self.data[self.at] << self.n
            self.at, self.n = self.at + 1, self.n + 8
        out = self.held & (1 << count) - 1
        self.held >>= count
        self.n -= count
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        bits = 0
        for size in range(1, 16):
            bits |= self.take(1) << size - 1
            if (bits, size) in codes:
                return codes[bits, size]
        raise CompressionError("imploded stream has an unknown code")


def _back(packed: bytes) -> dict[tuple[int, int], int]:
    return {code: s for s, code in _codes(packed).items()}


def explode(data: bytes) -> bytes:
    bits = _Bits(data)
    coded, window = bits.take(8), bits.take(8)
    if coded > 1 or not 4 <= window <= 6:
        raise CompressionError("not an imploded stream")
    literals, lengths, distances = _back(_LITERALS) if coded else {}, _back(_LENGTHS), _back(_DISTANCES)
    out = bytearray()
    while True:
        if not bits.take(1):
            out.append(bits.symbol(literals) if coded else bits.take(8))
            continue
        symbol = bits.symbol(lengths)
        size = _BASE[symbol] + bits.take(_EXTRA[symbol])
        if size == _END:
            return bytes(out)
        low = 2 if size == 2 else window
        distance = (bits.symbol(distances) << low | bits.take(low)) + 1
        if distance > len(out):
            raise CompressionError("imploded stream reaches before its beginning")
        if distance >= size:
            begin = len(out) - distance
            out += out[begin : begin + size]
        else:
            for _ in range(size):
                out.append(out[-distance])


def implode(data: bytes) -> bytes:
    window = 4 if len(data) <= 1024 else 5 if len(data) <= 2048 else 6
    reach = 1 << window + 6
    lengths, distances = _codes(_LENGTHS), _codes(_DISTANCES)
    out, held, n = bytearray([0, window]), 0, 0

    def put(bits: int, count: int) -> None:
        nonlocal held, n
        held |= bits << n
        n += count
        while n >= 8:
            out.append(held & 0xFF)
            held >>= 8
            n -= 8

    def length(size: int) -> None:
        symbol = max((s for s in range(16) if _BASE[s] <= size), key=lambda s: _BASE[s])
        put(*lengths[symbol])
        put(size - _BASE[symbol], _EXTRA[symbol])

    last: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        key, size, back = data[at : at + 3], 0, 0
        if len(key) == 3 and key in last and at - last[key] <= reach:
            back = at - last[key]
            most = min(_END - 1, len(data) - at)
            size = 3
            while size < most and data[at + size] == data[at + size - back]:
                size += 1
        if size >= 3:
            put(1, 1)
            length(size)
            put(*distances[back - 1 >> window])
            put(back - 1 & (1 << window) - 1, window)
        else:
            size = 1
            put(0, 1)
            put(data[at], 8)
        for i in range(at, min(at + size, len(data) - 2)):
            last[data[i : i + 3]] = i
        at += size
    put(1, 1)
    length(_END)
    if n:
        out.append(held & 0xFF)
    return bytes(out)
