"""Standard fonts: metrics, encoding, text width; embedding of TrueType fonts."""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache
from typing import Any

from foliospark.kernels.cmap import to_unicode_bytes
from foliospark.kernels.objects import Name, Stream
from foliospark.kernels.writer import Builder

LINE = 1.2

# Advance widths of the codes 32 to 126, per 1000 of the font size.
ASCII_WIDTHS = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
}
# The same of two more families.
ASCII_WIDTHS |= {
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
}
# Advance widths of the WinAnsi codes 127 to 191; 0 where there is no glyph.
SIGN_WIDTHS = {
    "Helvetica": "0 556 0 222 556 333 1000 556 556 333 1000 667 333 1000 0 611 0 0 222 222 333 333 350 556 1000 333 1000 500 333 944 0 500 667 278 333 556 556 556 556 260 556 333 737 370 556 584 0 737 333 400 584 333 333 333 0 537 278 333 333 365 556 834 834 834 611",
    "Helvetica-Bold": "0 556 0 278 556 500 1000 556 556 333 1000 667 333 1000 0 611 0 0 278 278 500 500 350 556 1000 333 1000 556 333 944 0 500 667 278 333 556 556 556 556 280 556 333 737 370 556 584 0 737 333 400 584 333 333 333 0 556 278 333 333 365 556 834 834 834 611",
    "Times-Roman": "0 500 0 333 500 444 1000 500 500 333 1000 556 333 889 0 611 0 0 333 333 444 444 350 500 1000 333 980 389 333 722 0 444 722 250 333 500 500 500 500 200 500 333 760 276 500 564 0 760 333 400 564 300 300 333 0 453 250 333 300 310 500 750 750 750 444",
    "Times-Bold": "0 500 0 333 500 500 1000 500 500 333 1000 556 333 1000 0 667 0 0 333 333 500 500 350 500 1000 333 1000 389 333 722 0 444 722 250 333 500 500 500 500 220 500 333 747 300 500 570 0 747 333 400 570 300 300 333 0 540 250 333 300 330 500 750 750 750 500",
    "Times-Italic": "0 500 0 333 500 556 889 500 500 333 1000 500 333 944 0 556 0 0 333 333 556 556 350 500 889 333 980 389 333 667 0 389 556 250 389 500 500 500 500 275 500 333 760 276 500 675 0 760 333 400 675 300 300 333 0 523 250 333 300 310 500 750 750 750 500",
    "Times-BoldItalic": "0 500 0 333 500 500 1000 500 500 333 1000 556 333 944 0 611 0 0 333 333 500 500 350 500 1000 333 1000 389 333 722 0 389 611 250 389 500 500 500 500 220 500 333 747 266 500 606 0 747 333 400 570 300 300 333 0 500 250 333 300 300 500 750 750 750 500",
}
# Æ, ß, æ and ø, which are as wide as no other letter.
LETTER_WIDTHS = {"Helvetica": (1000, 611, 889, 611), "Helvetica-Bold": (1000, 611, 889, 611), "Times-Roman": (889, 500, 667, 500), "Times-Bold": (1000, 556, 722, 500), "Times-Italic": (889, 500, 667, 500), "Times-BoldItalic": (944, 500, 722, 500)}
#: Letters as wide as another that no decomposition tells.
AS_WIDE_AS = {"Ð": "D", "Ø": "O", "Þ": "P", "ð": "o", "þ": "p", "×": "+", "÷": "+"}
#: Width of the accented forms of i.
ACCENTED_I = 278
# What the two symbol fonts have of WinAnsi, by code.
SYMBOLS = {
    "Symbol": {32: 250, 33: 333, 35: 500, 37: 833, 38: 778, 40: 333, 41: 333, 43: 549, 44: 250, 46: 250, 47: 278, **dict.fromkeys(range(48, 58), 500), 58: 278, 59: 278, 60: 549, 61: 549, 62: 549, 63: 444, 91: 333, 93: 333, 95: 500, 123: 480, 124: 200, 125: 480, 128: 750, 131: 500, 133: 1000, 149: 460, 160: 250, 172: 713, 176: 400, 177: 549, 215: 549, 247: 549},
    "ZapfDingbats": {32: 278, 160: 278},
}
#: Codes that WinAnsi leaves out.
UNASSIGNED = (127, 129, 141, 143, 144, 157)
# Ascender and descender.
VERTICAL = {"Helvetica": (718, -207), "Helvetica-Bold": (718, -207), "Times-Roman": (683, -217), "Times-Bold": (683, -217), "Times-Italic": (683, -217), "Times-BoldItalic": (683, -217), "Courier": (629, -157), "Symbol": (800, -200), "ZapfDingbats": (800, -200)}
#: Fonts that share a table.
SAME = {"Helvetica-Oblique": "Helvetica", "Helvetica-BoldOblique": "Helvetica-Bold", "Courier-Bold": "Courier", "Courier-Oblique": "Courier", "Courier-BoldOblique": "Courier"}
STANDARD = (*ASCII_WIDTHS, *SYMBOLS, "Courier", *SAME)
_loaded: dict[str, dict[int, int]] = {}


def with_afm(name: str, text: str) -> None:
    """Registers the widths of an AFM file, by code, under a name of its own or a standard one."""
    _loaded[name] = {int(c): int(float(w)) for c, w in re.findall(r"^C\s+(\d+)\s*;\s*WX\s+([\d.]+)", text, re.M)}
    widths.cache_clear()


@lru_cache(maxsize=32)
def widths(name: str) -> tuple[int, ...]:
    """Widths of the WinAnsi codes 0 to 255; an accented letter is as wide as its base letter."""
    if name in _loaded:
        return tuple(_loaded[name].get(k, 0) for k in range(256))
    name = SAME.get(name, name)
    if name == "Courier":
        return tuple(600 if k >= 32 and k not in UNASSIGNED else 0 for k in range(256))
    if name in SYMBOLS:
        return tuple(SYMBOLS[name].get(k, 0) for k in range(256))
    low = list(map(int, ASCII_WIDTHS[name].split()))
    own = dict(zip("Æßæø", LETTER_WIDTHS[name])) | dict.fromkeys("ìíîï", ACCENTED_I)

    def letter(c: str) -> int:
        base = AS_WIDE_AS.get(c) or unicodedata.normalize("NFKD", c)[0]
        return own[c] if c in own else low[ord(base) - 32]

    return (*(0,) * 32, *low, *map(int, SIGN_WIDTHS[name].split()), *(letter(chr(k)) for k in range(192, 256)))


def encode(text: str) -> bytes:
    """WinAnsi; what it lacks is dropped, as are control characters."""
    return "".join(c for c in text if ord(c) >= 32).encode("cp1252", "ignore")


def text_width(text: str, name: str = "Helvetica", size: float = 12.0) -> float:
    w = widths(name)
    return sum(map(w.__getitem__, encode(text))) * size / 1000


def vertical(name: str, size: float) -> tuple[float, float]:
    """Ascender and descender of a line, a fifth above the font's own."""
    a, d = VERTICAL.get(SAME.get(name, name), (700, -200))
    return a * size * LINE / 1000, d * size * LINE / 1000


def standard_font(name: str) -> dict:
    d = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(name)}
    return d if name in ("Symbol", "ZapfDingbats") else d | {"Encoding": Name("WinAnsiEncoding")}


class TrueType:
    """Metrics and character map of a TrueType or OpenType font file."""

    def __init__(self, data: bytes):
        self.data = data
        n = struct.unpack_from(">H", data, 4)[0]
        self.tables = {data[at : at + 4].decode("latin-1"): struct.unpack_from(">II", data, at + 8) for at in range(12, 12 + 16 * n, 16)}
        head, hhea = self._at("head"), self._at("hhea")
        self.units = struct.unpack_from(">H", data, head + 18)[0] or 1000
        self.box = struct.unpack_from(">4h", data, head + 36)
        self.ascent, self.descent = struct.unpack_from(">2h", data, hhea + 4)
        n_metrics = struct.unpack_from(">H", data, hhea + 34)[0]
        hmtx = self._at("hmtx")
        self.advances = [struct.unpack_from(">H", data, hmtx + 4 * k)[0] for k in range(n_metrics)] or [0]
        self.n_glyphs = struct.unpack_from(">H", data, self._at("maxp") + 4)[0] if "maxp" in self.tables else n_metrics
        # The Windows ascent and descent, which layout takes where the font has them.
        at, size = self.tables.get("OS/2", (0, 0))
        self.win = struct.unpack_from(">HH", data, at + 74) if size >= 78 else (0, 0)
        self.codes = self._cmap()
        self.name = self._name()

    def _at(self, table: str) -> int:
        if table not in self.tables:
            raise ValueError(f"font without {table}")
        return self.tables[table][0]

    def _cmap(self) -> dict[int, int]:
        data, base = self.data, self._at("cmap")
        best, score = {}, -1
        for k in range(struct.unpack_from(">H", data, base + 2)[0]):
            platform, encoding, at = struct.unpack_from(">HHI", data, base + 4 + 8 * k)
            rank = {(3, 10): 6, (0, 4): 5, (0, 6): 5, (3, 1): 4, (0, 3): 3, (3, 0): 2}.get((platform, encoding), 1)
            if rank > score and (codes := self._subtable(base + at)):
                if (platform, encoding) == (3, 0):  # symbol fonts hide ASCII in a private area
                    codes |= {c - 0xF000: g for c, g in codes.items() if 0xF000 <= c <= 0xF0FF}
                best, score = codes, rank
        return best

    def _subtable(self, at: int) -> dict[int, int]:
        data = self.data
        form = struct.unpack_from(">H", data, at)[0]
        if form == 0:
            return {c: g for c, g in enumerate(data[at + 6 : at + 262]) if g}
        if form == 6:
            first, n = struct.unpack_from(">HH", data, at + 6)
            return {first + k: g for k, g in enumerate(struct.unpack_from(f">{n}H", data, at + 10)) if g}
        if form == 12:
            out = {}
            for k in range(min(struct.unpack_from(">I", data, at + 12)[0], 65536)):
                low, high, glyph = struct.unpack_from(">III", data, at + 16 + 12 * k)
                out |= {c: glyph + c - low for c in range(low, min(high, low + 65535) + 1)}
            return out
        if form != 4:
            return {}
        n = struct.unpack_from(">H", data, at + 6)[0] // 2
        ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", data, at + 14 + 2 * n * k + 2 * (k > 0)) for k in range(4))
        out = {}
        for k in range(n):
            for c in range(starts[k], ends[k] + 1):
                if c == 0xFFFF:
                    continue
                if offsets[k]:
                    place = at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k])
                    glyph = struct.unpack_from(">H", data, place)[0] if place + 2 <= len(data) else 0
                    glyph = (glyph + deltas[k]) & 0xFFFF if glyph else 0
                else:
                    glyph = (c + deltas[k]) & 0xFFFF
                if glyph:
                    out[c] = glyph
        return out

    def _name(self) -> str:
        if "name" not in self.tables:
            return "Font"
        data, base = self.data, self._at("name")
        n, strings = struct.unpack_from(">HH", data, base + 2)
        found = {}
        for k in range(n):
            platform, _, _, kind, length, at = struct.unpack_from(">6H", data, base + 6 + 12 * k)
            if kind == 6:
                raw = data[base + strings + at : base + strings + at + length]
                found[platform] = raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "ignore")
        return re.sub(r"[^A-Za-z0-9+._-]", "", found.get(3) or next(iter(found.values()), "")) or "Font"

    def width(self, glyph: int) -> int:
        return round(self.advances[min(glyph, len(self.advances) - 1)] * 1000 / self.units)

    def vertical(self, size: float) -> tuple[float, float]:
        """Ascender and descender of a line: the Windows metrics, else the font's own and a fifth."""
        scale = lambda v: round(v * 1000 / self.units)
        a = scale(self.win[0]) if self.win[0] else scale(self.ascent) * LINE
        d = -scale(self.win[1]) if self.win[1] else scale(self.descent) * LINE
        return a * size / 1000, d * size / 1000

    def text_width(self, text: str, size: float) -> float:
        return sum(self.width(self.codes.get(ord(c), 0)) for c in text) * size / 1000

    def encode(self, text: str) -> bytes:
        return b"".join(self.codes.get(ord(c), 0).to_bytes(2) for c in text)

    def embed(self, target: Builder) -> dict:
        """A composite font with the whole file, widths and a map to Unicode."""
        scale = lambda v: round(v * 1000 / self.units)
        file = target.add(Stream({"Length1": len(self.data)}, self.data))
        descriptor = target.add({"Type": Name("FontDescriptor"), "FontName": Name(self.name), "Flags": 32, "FontBBox": [scale(v) for v in self.box], "ItalicAngle": 0, "Ascent": scale(self.ascent), "Descent": scale(self.descent), "CapHeight": scale(self.ascent), "StemV": 80, "FontFile2": file})
        glyphs: dict[int, str] = {}
        for c, g in sorted(self.codes.items()):
            glyphs.setdefault(g, chr(c))
        w: list[Any] = []
        for g in sorted(glyphs):
            w += [g, [self.width(g)]]
        cid = target.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name(self.name), "CIDSystemInfo": {"Registry": "Adobe", "Ordering": "Identity", "Supplement": 0}, "FontDescriptor": descriptor, "W": w, "DW": self.width(0), "CIDToGIDMap": Name("Identity")})
        return {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(self.name), "Encoding": Name("Identity-H"), "DescendantFonts": [cid], "ToUnicode": target.add(Stream({}, to_unicode_bytes(glyphs)))}
