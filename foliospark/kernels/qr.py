"""QR codes, versions 1 to 40."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

LEVELS = "LMQH"
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
#: Bytes kept free for the header when a version is chosen.
RESERVE = 3

# Error-correction codewords of a block, and blocks, by version.
EC = {
    "L": "7 10 15 20 26 18 20 24 30 18 20 24 26 30 22 24 28 30 28 28 28 28 30 30 26 28 30 30 30 30 30 30 30 30 30 30 30 30 30 30",
    "M": "10 16 26 18 24 16 18 22 22 26 30 22 22 24 24 28 28 26 26 26 26 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28 28",
    "Q": "13 22 18 26 18 24 18 22 20 24 28 26 24 20 30 24 28 28 26 30 28 30 30 30 30 28 30 30 30 30 30 30 30 30 30 30 30 30 30 30",
    "H": "17 28 22 16 22 28 26 26 24 28 24 28 22 24 24 30 28 28 26 28 30 24 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30 30",
}
BLOCKS = {
    "L": "1 1 1 1 1 2 2 2 2 4 4 4 4 4 6 6 6 6 7 8 8 9 9 10 12 12 12 13 14 15 16 17 18 19 19 20 21 22 24 25",
    "M": "1 1 1 2 2 4 4 4 5 5 5 8 9 9 10 10 11 13 14 16 17 17 18 20 21 23 25 26 28 29 31 33 35 37 38 40 43 45 47 49",
    "Q": "1 1 2 2 4 4 6 6 8 8 8 10 12 16 12 17 16 18 21 20 23 23 25 27 29 34 34 35 38 40 43 45 48 51 53 56 59 62 65 68",
    "H": "1 1 2 4 4 4 5 6 8 8 11 11 16 16 18 16 19 21 25 25 25 34 30 32 35 37 40 42 45 48 51 54 57 60 63 66 70 74 77 81",
}
_ec = {k: list(map(int, v.split())) for k, v in EC.items()}
_blocks = {k: list(map(int, v.split())) for k, v in BLOCKS.items()}
assert all(len(v) == 40 for v in [*_ec.values(), *_blocks.values()])


def raw_codewords(version: int) -> int:
    """Codewords of a symbol, from the modules that no pattern takes."""
    n = (16 * version + 128) * version + 64
    if version >= 2:
        k = version // 7 + 2
        n -= (25 * k - 10) * k - 55
        if version >= 7:
            n -= 36
    return n // 8


def data_codewords(version: int, level: str) -> int:
    return raw_codewords(version) - _ec[level][version - 1] * _blocks[level][version - 1]


def alignment(version: int) -> list[int]:
    """Centres of the alignment patterns, evenly from the far end."""
    if version == 1:
        return []
    k, size = version // 7 + 2, 17 + 4 * version
    step = (version * 8 + k * 3 + 5) // (k * 4 - 4) * 2
    return [6, *sorted(size - 7 - step * j for j in range(k - 1))]


def mode_of(content: str) -> str:
    return "numeric" if re.fullmatch(r"[0-9]+", content) else "alphanumeric" if re.fullmatch(r"[0-9A-Z $%*+\-./:]+", content) else "byte"


def body_bits(content: str, mode: str) -> int:
    n = len(content)
    return {"numeric": n // 3 * 10 + (0, 4, 7)[n % 3], "alphanumeric": n // 2 * 11 + n % 2 * 6, "byte": 8 * n}[mode]


@lru_cache(maxsize=4)
def _rooms(level: str) -> list[int]:
    return [data_codewords(v, level) for v in range(1, 41)]


def version_of(content: str, level: str = "M") -> int:
    need = (body_bits(content, mode_of(content)) + 7) // 8 + RESERVE
    for v, room in enumerate(_rooms(level), 1):
        if room >= need:
            return v
    raise ValueError("too long for a QR code")


def _data(content: str, mode: str, version: int, level: str) -> bytes:
    wide = (version > 9) + (version > 26)
    parts = [{"numeric": "0001", "alphanumeric": "0010", "byte": "0100"}[mode], f"{len(content):0{ {'numeric': (10, 12, 14), 'alphanumeric': (9, 11, 13), 'byte': (8, 16, 16)}[mode][wide] }b}"]
    if mode == "numeric":
        parts += [f"{int(part):0{(4, 7, 10)[len(part) - 1]}b}" for part in (content[k : k + 3] for k in range(0, len(content), 3))]
    elif mode == "alphanumeric":
        values = [ALPHANUMERIC.index(c) for c in content]
        parts += [f"{a * 45 + b:011b}" for a, b in zip(values[::2], values[1::2])] + ([f"{values[-1]:06b}"] if len(values) % 2 else [])
    else:
        parts += [f"{b:08b}" for b in content.encode("latin-1", "replace")]
    bits = "".join(parts)
    room = _rooms(level)[version - 1]
    bits += "0" * min(4, room * 8 - len(bits))
    bits += "0" * (-len(bits) % 8)
    n = len(bits) // 8
    return int(bits, 2).to_bytes(n) + (b"\xec\x11" * room)[: room - n]


def _field() -> tuple[list[int], list[int]]:
    exp, log, x = [0] * 512, [0] * 256, 1
    for k in range(255):
        exp[k] = exp[k + 255] = x
        log[x] = k
        x = x << 1 ^ (0x11D if x & 128 else 0)
    return exp, log


_exp, _log = _field()


def _times(a: int, b: int) -> int:
    return _exp[_log[a] + _log[b]] if a and b else 0


@lru_cache(maxsize=64)
def _multiples(n: int) -> list[int]:
    """The generator of n check bytes without its leading term, times each byte, as one number."""
    generator = [1]
    for k in range(n):
        generator = [a ^ _times(b, _exp[k]) for a, b in zip([*generator, 0], [0, *generator])]
    return [int.from_bytes(bytes(_times(lead, g) for g in generator[1:])) for lead in range(256)]


def remainder(data: bytes | list[int], n: int) -> list[int]:
    """Reed-Solomon check bytes."""
    times, top, low = _multiples(n), 8 * (n - 1), (1 << 8 * (n - 1)) - 1
    out = 0
    for byte in data:
        out = (out & low) << 8 ^ times[byte ^ out >> top]
    return list(out.to_bytes(n))


def codewords(content: str, version: int, level: str) -> list[int]:
    data = _data(content, mode_of(content), version, level)
    n, ec = _blocks[level][version - 1], _ec[level][version - 1]
    short, longer = len(data) // n, len(data) % n
    parts, at = [], 0
    for k in range(n):
        size = short + (k >= n - longer)
        parts.append(data[at : at + size])
        at += size
    checks = [remainder(p, ec) for p in parts]
    out = [p[k] for k in range(short + 1) for p in parts if k < len(p)]
    return out + [c[k] for k in range(ec) for c in checks]


def _patterns(version: int) -> tuple[np.ndarray, np.ndarray]:
    """(modules, which of them are fixed) with format and version areas reserved."""
    size = 17 + 4 * version
    m, fixed = np.zeros((size, size), bool), np.zeros((size, size), bool)
    m[6, :] = m[:, 6] = np.arange(size) % 2 == 0
    fixed[6, :] = fixed[:, 6] = True
    for cy, cx in ((3, 3), (3, size - 4), (size - 4, 3)):
        for y in range(max(0, cy - 4), min(size, cy + 5)):
            for x in range(max(0, cx - 4), min(size, cx + 5)):
                m[y, x] = max(abs(y - cy), abs(x - cx)) not in (2, 4)
                fixed[y, x] = True
    places = alignment(version)
    last = len(places) - 1
    for i, cy in enumerate(places):
        for j, cx in enumerate(places):
            if (i, j) in ((0, 0), (0, last), (last, 0)):
                continue
            for y in range(cy - 2, cy + 3):
                for x in range(cx - 2, cx + 3):
                    m[y, x] = max(abs(y - cy), abs(x - cx)) != 1
                    fixed[y, x] = True
    fixed[8, :9] = fixed[:9, 8] = fixed[8, -8:] = fixed[-8:, 8] = True
    m[size - 8, 8] = True
    if version >= 7:
        rest = version
        for _ in range(12):
            rest = rest << 1 ^ (rest >> 11) * 0x1F25
        word = version << 12 | rest
        for k in range(18):
            y, x = k // 3, size - 11 + k % 3
            m[y, x] = m[x, y] = word >> k & 1
            fixed[y, x] = fixed[x, y] = True
    return m, fixed


def _format(m: np.ndarray, level: str, mask: int) -> None:
    data = {"L": 1, "M": 0, "Q": 3, "H": 2}[level] << 3 | mask
    rest = data
    for _ in range(10):
        rest = rest << 1 ^ (rest >> 9) * 0x537
    word = (data << 10 | rest) ^ 0x5412
    size = len(m)
    bit = lambda k: bool(word >> k & 1)
    for k in range(6):
        m[k, 8] = bit(k)
    m[7, 8], m[8, 8], m[8, 7] = bit(6), bit(7), bit(8)
    for k in range(9, 15):
        m[8, 14 - k] = bit(k)
    for k in range(8):
        m[8, size - 1 - k] = bit(k)
    for k in range(8, 15):
        m[size - 15 + k, 8] = bit(k)
    m[size - 8, 8] = True


MASKS = [
    lambda y, x: (y + x) % 2 == 0,
    lambda y, x: y % 2 == 0,
    lambda y, x: x % 3 == 0,
    lambda y, x: (y + x) % 3 == 0,
    lambda y, x: (y // 2 + x // 3) % 2 == 0,
    lambda y, x: y * x % 2 + y * x % 3 == 0,
    lambda y, x: (y * x % 2 + y * x % 3) % 2 == 0,
    lambda y, x: ((y + x) % 2 + y * x % 3) % 2 == 0,
]


def _number(m: np.ndarray) -> int:
    """The modules, line after line, as the bits of one number."""
    return int("".join("01"[v] for v in m.ravel().tolist()), 2)


@lru_cache(maxsize=40)
def _inside(size: int) -> tuple[int, int, int]:
    """At which bits stretches of 5 and of 11 modules of a line end, and squares of four modules."""
    ends = lambda n, rows: _number(np.tile(np.arange(size) >= n - 1, (rows, 1)))
    return ends(5, size), ends(11, size), ends(2, size - 1)


def _penalty(by_row: int, by_column: int, size: int) -> int:
    """Penalty of the modules, given line by line both ways; a line's modules are neighbouring bits, so that all lines are searched at once."""
    fives, elevens, squares = _inside(size)
    out, every = 0, (1 << size * size) - 1
    for x in (by_row, by_column):
        y = x ^ every
        a, b = x & x >> 1, y & y >> 1
        five = ((a & a >> 2 & x >> 4) | (b & b >> 2 & y >> 4)) & fives
        # Runs of five or more count for their length less 2: each stretch of five once, and 2 for each run, where no stretch precedes.
        n = five.bit_count()
        out += n + 2 * (n - (five & five >> 1).bit_count())
        core = x & y >> 1 & x >> 2 & a >> 2 & x >> 4 & y >> 5 & x >> 6  # 1011101
        quiet = b & b >> 2
        out += 40 * ((quiet & core >> 4 & elevens).bit_count() + (core & quiet >> 7 & elevens).bit_count())
    alike = by_row ^ by_row >> 1
    below = by_row ^ by_row >> size
    out += 3 * (squares & ~(alike | below | alike >> size)).bit_count()
    return out + 10 * (abs(by_row.bit_count() * 20 - size * size * 10) // (size * size))


def penalty(m: np.ndarray) -> int:
    return _penalty(_number(m), _number(m.T), len(m))


@lru_cache(maxsize=40)
def _places(version: int) -> tuple[np.ndarray, np.ndarray]:
    """The modules of the patterns, and where codewords' bits go, in order, as flat places."""
    m, fixed = _patterns(version)
    size, order = len(m), []
    up, x = True, len(m) - 1
    while x > 0:
        if x == 6:
            x -= 1
        order += [y * size + c for y in (range(size - 1, -1, -1) if up else range(size)) for c in (x, x - 1) if not fixed[y, c]]
        up, x = not up, x - 2
    return m, np.array(order)


@lru_cache(maxsize=160)
def _masked(version: int, level: str) -> list[tuple[int, int]]:
    """Of each mask, what it flips together with its format, line by line both ways."""
    m, fixed = _patterns(version)
    ys, xs = np.indices(m.shape)
    out = []
    for k, rule in enumerate(MASKS):
        t = m ^ (rule(ys, xs) & ~fixed)
        _format(t, level, k)
        out.append((_number(t ^ m), _number((t ^ m).T)))
    return out


def _symbol(content: str, level: str) -> tuple[int, int]:
    """(modules as the bits of one number, size), under the mask of least penalty (the first of equals)."""
    version = version_of(content, level)
    m, order = _places(version)
    size = len(m)
    bits = np.unpackbits(np.array(codewords(content, version, level), np.uint8))
    m = m.copy()
    m.reshape(-1)[order[: len(bits)]] = bits
    packed = lambda x: int.from_bytes(np.packbits(x).tobytes()) >> -size * size % 8
    by_row, by_column = packed(m), packed(m.T)
    best = min(_masked(version, level), key=lambda flips: _penalty(by_row ^ flips[0], by_column ^ flips[1], size))
    return by_row ^ best[0], size


def matrix(content: str, level: str = "M") -> np.ndarray:
    """Modules, dark ones true."""
    return np.array([[c == "1" for c in r] for r in rows(content, level)])


def rows(content: str, level: str = "M") -> list[str]:
    x, size = _symbol(content, level)
    flat = f"{x:0{size * size}b}"
    return [flat[k : k + size] for k in range(0, size * size, size)]
