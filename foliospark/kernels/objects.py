"""The object model: plain Python values, with types of their own only where PDF needs them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple


class Name(str):
    """A name, #xx already decoded."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int = 0


class Keyword(bytes):
    """An operator or a structural word."""

    __slots__ = ()


class PdfString(bytes):
    """String bytes; hexed marks the notation that they came in."""

    hexed = False

    @property
    def text(self) -> str:
        return string_text(self)


@dataclass
class Stream:
    dict: dict = field(default_factory=dict)
    raw: bytes = b""


# PDFDocEncoding where it differs from Latin-1.
PDFDOC = {
    0x18: "˘", 0x19: "ˇ", 0x1A: "ˆ", 0x1B: "˙", 0x1C: "˝", 0x1D: "˛", 0x1E: "˚", 0x1F: "˜",
    0x80: "•", 0x81: "†", 0x82: "‡", 0x83: "…", 0x84: "—", 0x85: "–", 0x86: "ƒ", 0x87: "⁄", 0x88: "‹", 0x89: "›", 0x8A: "−", 0x8B: "‰",
    0x8C: "„", 0x8D: "“", 0x8E: "”", 0x8F: "‘", 0x90: "’", 0x91: "‚", 0x92: "™", 0x93: "ﬁ", 0x94: "ﬂ", 0x95: "Ł", 0x96: "Œ", 0x97: "Š",
    0x98: "Ÿ", 0x99: "Ž", 0x9A: "ı", 0x9B: "ł", 0x9C: "œ", 0x9D: "š", 0x9E: "ž", 0xA0: "€",
}
_to_pdfdoc = {c: b for b, c in PDFDOC.items()} | {chr(b): b for b in range(256) if b not in PDFDOC}


def string_text(data: bytes) -> str:
    """UTF-16 or UTF-8 if marked so, else PDFDocEncoding."""
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    return "".join(PDFDOC.get(b) or chr(b) for b in data)


def text_string(text: str) -> PdfString:
    """PDFDocEncoding where it can say the text (and isn't mistaken for a mark), else UTF-16."""
    try:
        data = bytes(_to_pdfdoc[c] for c in text)
    except KeyError:
        data = b""
    if len(data) != len(text) or data[:2] == b"\xfe\xff" or data[:3] == b"\xef\xbb\xbf":
        return PdfString(b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass"))
    return PdfString(data)


def number(x: Any, default: float | None = None) -> float | None:
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else default


def integer(x: Any, default: int | None = None) -> int | None:
    return int(x) if isinstance(x, int | float) and not isinstance(x, bool) else default
