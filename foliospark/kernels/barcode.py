"""Linear barcodes as strings of 0 and 1, and as bars."""

from __future__ import annotations

import re

# Code 128 bar and space widths by value; the last is the stop.
CODE128 = """
212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132
221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313
231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111
314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111
111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141
114131 311141 411131 211412 211214 211232 2331112
""".split()
# Code 39, n narrow and w wide, bars and spaces in turn.
CODE39 = dict(
    zip(
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. $/+%*",
        """nnnwwnwnn wnnwnnnnw nnwwnnnnw wnwwnnnnn nnnwwnnnw wnnwwnnnn nnwwwnnnn nnnwnnwnw wnnwnnwnn nnwwnnwnn
        wnnnnwnnw nnwnnwnnw wnwnnwnnn nnnnwwnnw wnnnwwnnn nnwnwwnnn nnnnnwwnw wnnnnwwnn nnwnnwwnn nnnnwwwnn
        wnnnnnnww nnwnnnnww wnwnnnnwn nnnnwnnww wnnnwnnwn nnwnwnnwn nnnnnnwww wnnnnnwwn nnwnnnwwn nnnnwnwwn
        wwnnnnnnw nwwnnnnnw wwwnnnnnn nwnnwnnnw wwnnwnnnn nwwnwnnnn nwnnnnwnw wwnnnnwnn nwwnnnwnn nwnwnwnnn
        nwnwnnnwn nwnnnwnwn nnnwnwnwn nwnnwnwnn""".split(),
    )
)
# EAN left odd codes, parity by first digit, and Interleaved 2 of 5.
EAN_L = "0001101 0011001 0010011 0111101 0100011 0110001 0101111 0111011 0110111 0001011".split()
EAN_PARITY = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()
ITF = "nnwwn wnnnw nwnnw wwnnn nnwnw wnwnn nwwnn nnnww wnnwn nwnwn".split()
QUIET = {"ean13": (11, 7), "upca": (11, 7)}

assert len(CODE128) == 107 and all(sum(map(int, p)) == (13 if k == 106 else 11) for k, p in enumerate(CODE128))
assert len(CODE39) == 44 and all(p.count("w") == 3 and len(p) == 9 for p in CODE39.values())
assert all(p.count("w") == 2 for p in ITF) and len({*EAN_L}) == 10


def _widths(pattern: str) -> str:
    return "".join(("1", "0")[k % 2] * int(w) for k, w in enumerate(pattern))


def code128_values(content: str) -> list[int]:
    """Start, data and switches, without check and stop: digits in pairs where four or more run, or all that is left."""
    if not content or any(ord(c) > 127 for c in content):
        raise ValueError("Code 128 takes one ASCII character or more")
    out: list[int] = []
    now = ""

    def switch(to: str) -> None:
        nonlocal now
        if now != to:
            out.append({"A": 103, "B": 104, "C": 105}[to] if not now else {"A": 101, "B": 100, "C": 99}[to])
            now = to

    at = 0
    while at < len(content):
        run = len(re.match(r"[0-9]*", content[at:])[0])
        if now == "C" and run >= 2 or now != "C" and (run >= 4 or run >= 2 and at + run == len(content)):
            if run % 2 and now != "C":
                switch("B" if now == "" else now)
                out.append(ord(content[at]) - 32)
                at, run = at + 1, run - 1
            switch("C")
            for k in range(at, at + run // 2 * 2, 2):
                out.append(int(content[k : k + 2]))
            at += run // 2 * 2
            continue
        c = ord(content[at])
        if c < 32:
            switch("A")
        elif now not in ("A", "B") or now == "A" and c >= 96:
            switch("B")
        out.append(c + 64 if c < 32 else c - 32)
        at += 1
    return out


def code128(content: str) -> str:
    v = code128_values(content)
    check = (v[0] + sum(k * x for k, x in enumerate(v[1:], 1))) % 103
    return "".join(_widths(CODE128[x]) for x in [*v, check, 106])


def code39(content: str, check: bool = False) -> str:
    """Upper-cased; a wide element is three modules."""
    content = content.upper()
    if not content or any(c not in CODE39 or c == "*" for c in content):
        raise ValueError("Code 39 can't say this")
    if check:
        order = list(CODE39)
        content += order[sum(map(order.index, content)) % 43]
    return "0".join("".join(("1", "0")[k % 2] * (3 if w == "w" else 1) for k, w in enumerate(CODE39[c])) for c in f"*{content}*")


def ean_check(digits: str) -> int:
    return -sum(int(d) * (3 if k % 2 == 0 else 1) for k, d in enumerate(reversed(digits))) % 10


def ean13(content: str) -> str:
    if not re.fullmatch(r"[0-9]{12,13}", content):
        raise ValueError("EAN-13 takes 12 or 13 digits")
    if len(content) == 13 and int(content[12]) != ean_check(content[:12]):
        raise ValueError("EAN-13 check digit differs")
    d = content[:12] + str(ean_check(content[:12]))
    mirror = str.maketrans("01", "10")
    right = [c.translate(mirror) for c in EAN_L]
    left = "".join(EAN_L[int(x)] if p == "L" else right[int(x)][::-1] for x, p in zip(d[1:7], EAN_PARITY[int(d[0])]))
    return "101" + left + "01010" + "".join(right[int(x)] for x in d[7:]) + "101"


def upca(content: str) -> str:
    if not re.fullmatch(r"[0-9]{11,12}", content):
        raise ValueError("UPC-A takes 11 or 12 digits")
    return ean13("0" + content)


def itf(content: str) -> str:
    """An odd number of digits gets a leading zero; a wide element is three modules."""
    if not re.fullmatch(r"[0-9]+", content):
        raise ValueError("Interleaved 2 of 5 takes digits")
    content = content.zfill(len(content) + len(content) % 2)
    out = "1010"
    for a, b in zip(content[::2], content[1::2]):
        for p, q in zip(ITF[int(a)], ITF[int(b)]):
            out += "1" * (3 if p == "w" else 1) + "0" * (3 if q == "w" else 1)
    return out + "11101"


KINDS = {"code128": code128, "code39": code39, "ean13": ean13, "upca": upca, "itf": itf}


def encode(content: str, kind: str) -> str:
    if not content:
        raise ValueError("nothing to encode")
    return KINDS[kind](content)


def bars(modules: str, kind: str = "code128") -> list[tuple[int, int]]:
    """(first module, width) of each bar, after the quiet zone."""
    quiet = QUIET.get(kind, (10, 10))[0]
    return [(m.start() + quiet, len(m[0])) for m in re.finditer("1+", modules)]
