"""ToUnicode maps: from code to text, and from text to code."""

from __future__ import annotations

from foliospark.kernels.objects import Keyword, PdfString
from foliospark.kernels.syntax import END, Reader

MOST_ENTRIES = 100_000


class ToUnicode:
    def __init__(self):
        self.codes: dict[tuple[int, int], str] = {}
        self.lengths: list[int] = []

    @classmethod
    def parse(cls, data: bytes) -> ToUnicode:
        self, r, operands, lengths = cls(), Reader(data), [], set()
        while (x := r.object()) is not END:
            if not isinstance(x, Keyword):
                operands.append(x)
                continue
            if x == b"endcodespacerange":
                lengths |= {len(v) for v in operands if isinstance(v, PdfString)}
            elif x == b"endbfchar":
                for code, text in zip(operands[::2], operands[1::2]):
                    self._put(code, text)
            elif x == b"endbfrange":
                for low, high, to in zip(operands[::3], operands[1::3], operands[2::3]):
                    self._range(low, high, to)
            operands = []
        self.lengths = sorted(lengths | {n for n, _ in self.codes}) or [1]
        return self

    def _put(self, code, text) -> None:
        if isinstance(code, PdfString) and isinstance(text, PdfString) and len(self.codes) < MOST_ENTRIES:
            self.codes[len(code), int.from_bytes(code)] = text.decode("utf-16-be", "replace") if len(text) > 1 else text.decode("latin-1")

    def _range(self, low, high, to) -> None:
        if not isinstance(low, PdfString) or not isinstance(high, PdfString):
            return
        first, n = int.from_bytes(low), int.from_bytes(high) - int.from_bytes(low) + 1
        for k in range(min(max(n, 0), MOST_ENTRIES - len(self.codes))):
            code = PdfString((first + k).to_bytes(len(low)))
            if isinstance(to, list):
                if k < len(to):
                    self._put(code, to[k])
            elif isinstance(to, PdfString) and to:
                self._put(code, PdfString((int.from_bytes(to) + k).to_bytes(len(to) + 1)[-len(to) :]))

    def decode(self, data: bytes) -> str:
        """Shortest codes first; U+FFFD for what no code of any length maps."""
        out, at = [], 0
        while at < len(data):
            for n in self.lengths:
                if at + n <= len(data) and (text := self.codes.get((n, int.from_bytes(data[at : at + n])))) is not None:
                    out.append(text)
                    at += n
                    break
            else:
                out.append("�")
                at += self.lengths[0]
        return "".join(out)


def to_unicode_bytes(codes: dict[int, str], width: int = 2, block: int = 100) -> bytes:
    """The map of codes, in blocks of at most 100."""
    items = sorted(codes.items())
    parts = ["/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Adobe-Identity-UCS def /CMapType 2 def", f"1 begincodespacerange <{'00' * width}> <{'FF' * width}> endcodespacerange"]
    for at in range(0, len(items), block):
        part = items[at : at + block]
        rows = "\n".join(f"<{c:0{2 * width}X}> <{t.encode('utf-16-be').hex().upper()}>" for c, t in part)
        parts.append(f"{len(part)} beginbfchar\n{rows}\nendbfchar")
    return "\n".join([*parts, "endcmap CMapName currentdict /CMap defineresource pop end end"]).encode()
