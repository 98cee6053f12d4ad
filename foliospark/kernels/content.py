"""Content streams: operators, the interpreter that turns them into events, and layer flattening."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from foliospark.kernels.cmap import ToUnicode
from foliospark.kernels.document import Document, Page
from foliospark.kernels.filters import SHORT
from foliospark.kernels.objects import Keyword, Name, PdfString, Stream, integer, number
from foliospark.kernels.syntax import END, SPACE, Reader

OPERANDS, FORM_DEPTH, CURVE_STEPS = 64, 12, 12
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
STROKE, FILL = 1, 2

# Painting operators as (closes the path, what it paints).
PAINT = {b"S": (0, 1), b"s": (1, 1), b"f": (0, 2), b"F": (0, 2), b"f*": (0, 2), b"B": (0, 3), b"B*": (0, 3), b"b": (1, 3), b"b*": (1, 3), b"n": (0, 0)}
# Abbreviated keys and colour spaces of inline images.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
INLINE_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
# Glyph names that aren't letters.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "Euro": "€", "fi": "ﬁ", "fl": "ﬂ",
}


_LATIN = tuple(map(chr, range(256)))
_WIN_ANSI = tuple(bytes([k]).decode("cp1252", "replace") for k in range(256))


def _win_ansi(data: bytes) -> str:
    return data.decode("cp1252", "replace")


def _latin(data: bytes) -> str:
    return data.decode("latin-1")


def multiply(m: tuple, n: tuple) -> tuple:
    """m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def glyph_text(name: str) -> str:
    if name in GLYPHS:
        return GLYPHS[name]
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})", name):
        return chr(int(m[1], 16))
    return name if len(name) == 1 else "�"


def font_decoder(doc: Document, font: Any) -> Callable[[bytes], str]:
    """ToUnicode, else the codes of a composite font, else a simple font's encoding and its differences."""
    font = font if isinstance(font, dict) else {}
    s = doc.get(font.get("ToUnicode"))
    if isinstance(s, Stream) and (data := doc.decoded(s)) is not None:
        return ToUnicode.parse(data).decode
    if font.get("Subtype") == "Type0":
        return lambda x: x[: len(x) // 2 * 2].decode("utf-16-be", "replace")
    e = doc.get(font.get("Encoding"))
    base = e.get("BaseEncoding") if isinstance(e, dict) else e
    if not isinstance(e, dict):
        return _win_ansi if base == "WinAnsiEncoding" else _latin
    table = list(_WIN_ANSI if base == "WinAnsiEncoding" else _LATIN)
    at = 0
    for x in doc.get(e.get("Differences")) or []:
        if isinstance(x, Name):
            if at < 256:
                table[at] = glyph_text(x)
            at += 1
        else:
            at = integer(x, 0)
    return lambda x: "".join(map(table.__getitem__, x))


@dataclass(slots=True)
class State:
    ctm: tuple = IDENTITY
    line_width: float = 1.0
    font: Any = None
    font_size: float = 0.0
    render_mode: int = 0
    leading: float = 0.0

    def copy(self) -> State:
        return State(self.ctm, self.line_width, self.font, self.font_size, self.render_mode, self.leading)


@dataclass
class Interpreter:
    """Events of a page, as dictionaries in order. Text never advances by glyph widths: one event a shown string."""

    doc: Document
    events: list = field(default_factory=list)
    ops: list = field(default_factory=list)
    keep_ops: bool = False
    decoders: dict = field(default_factory=dict)

    def page(self, page: Page) -> list[dict]:
        return self.run(page.content(), page.resources)

    def run(self, content: bytes, resources: dict) -> list[dict]:
        self.state, self.stack, self.tags = State(), [], []
        self.path: list[list] = []
        self.tm = self.lm = IDENTITY
        self.floor = 0
        self._execute(content, resources, 0, set())
        return self.events

    def _execute(self, content: bytes, resources: dict, depth: int, active: set) -> None:
        held, self.floor, scope = self.floor, len(self.stack), (resources, depth, active, {})
        for op, operands, _, _, values, act in program(content):
            if self.keep_ops:
                self.ops.append((op.decode("latin-1"), len(operands) - (op == b"BI"), depth))
            if act is not None:
                act(self, operands, values, scope)
        while len(self.stack) > self.floor:
            self.state = self.stack.pop()
        self.floor = held

    def _emit(self, kind: str, depth: int, **more: Any) -> None:
        s = self.state
        self.events.append({"seq": len(self.events), "depth": depth, "kind": kind, "ctm": s.ctm, "line_width": s.line_width, "tags": [t for t in reversed(self.tags) if t] if self.tags else [], **more})

    def _resource(self, scope: tuple, kind: str, name: Any) -> Any:
        if not isinstance(name, Name):
            return None
        resources, _, _, found = scope
        if (kind, name) not in found:
            group = self.doc.get(resources.get(kind))
            found[kind, name] = self.doc.get(group.get(name)) if isinstance(group, dict) else None
        return found[kind, name]

    def _graphics(self, d: Any) -> None:
        if isinstance(d, dict):
            self.state.line_width = number(self.doc.get(d.get("LW")), self.state.line_width)
            font = self.doc.get(d.get("Font"))
            if isinstance(font, list) and len(font) >= 2:
                self.state.font, self.state.font_size = self.doc.get(font[0]), number(font[1], self.state.font_size)

    def _at(self) -> tuple:
        return self.path[-1][1][-1] if self.path else (0.0, 0.0)

    def _to(self, points: list) -> None:
        if not self.path:
            self.path.append([False, [], []])
        self.path[-1][1].extend(points)

    def _curve(self, b: tuple, c: tuple, d: tuple) -> None:
        self._to(curve_points(self._at(), b, c, d))

    def _line(self, x: float, y: float) -> None:
        self.lm = self.tm = multiply((1, 0, 0, 1, x, y), self.lm)

    def _show(self, data: bytes, depth: int) -> None:
        s = self.state
        key = id(s.font)
        if key not in self.decoders:
            self.decoders[key] = (s.font, font_decoder(self.doc, s.font))
        self._emit("text", depth, text=self.decoders[key][1](data), font_size=s.font_size, render_mode=s.render_mode, tm=self.tm)

    def _xobject(self, scope: tuple, name: Name) -> None:
        resources, depth, active, _ = scope
        x = self._resource(scope, "XObject", name)
        if not isinstance(x, Stream):
            return
        if x.dict.get("Subtype") == "Image":
            self._emit("image", depth, img_w=integer(self.doc.get(x.dict.get("Width")), 0), img_h=integer(self.doc.get(x.dict.get("Height")), 0))
        elif x.dict.get("Subtype") == "Form" and depth < FORM_DEPTH and id(x) not in active:
            data = self.doc.decoded(x)
            if data is None:
                return
            held = self.state.copy(), self.tags, self.path, self.tm, self.lm
            m = floats([self.doc.get(v) for v in self.doc.get(x.dict.get("Matrix")) or []], 6)
            if m:
                self.state.ctm = multiply(m, self.state.ctm)
            self.tags, self.path = list(self.tags), []
            own = self.doc.get(x.dict.get("Resources"))
            self._execute(data, own if isinstance(own, dict) else resources, depth + 1, active | {id(x)})
            self.state, self.tags, self.path, self.tm, self.lm = held


def floats(operands: list | tuple, n: int) -> tuple | None:
    """The last n operands, if they are numbers."""
    out = tuple(map(number, operands[-n:]))
    return out if len(out) == n and None not in out else None


def _last(values: tuple | None, args: list | tuple, n: int) -> tuple | None:
    """floats(), from the values of an operator whose operands are all numbers."""
    return floats(args, n) if values is None else values[-n:] if len(values) >= n else None


# One function an operator: interpreter, operands, their values if all are numbers, and (resources, depth, active forms, resources found).


def _save(i, args, values, scope):
    i.stack.append(i.state)
    i.state = i.state.copy()


def _restore(i, args, values, scope):
    if len(i.stack) > i.floor:
        i.state = i.stack.pop()


def _concat(i, args, values, scope):
    if v := _last(values, args, 6):
        i.state.ctm = multiply(v, i.state.ctm)


def _width(i, args, values, scope):
    if v := _last(values, args, 1):
        i.state.line_width = v[0]


def _state(i, args, values, scope):
    if args:
        i._graphics(i._resource(scope, "ExtGState", args[-1]))


def _move(i, args, values, scope):
    if v := _last(values, args, 2):
        i.path.append([False, [v], []])


def _to(i, args, values, scope):
    if v := _last(values, args, 2):
        i._to([v])


def _c(i, args, values, scope):
    if v := _last(values, args, 6):
        i._curve(v[0:2], v[2:4], v[4:6])


def _v(i, args, values, scope):
    if v := _last(values, args, 4):
        i._curve(i._at(), v[0:2], v[2:4])


def _y(i, args, values, scope):
    if v := _last(values, args, 4):
        i._curve(v[0:2], v[2:4], v[2:4])


def _close(i, args, values, scope):
    if i.path:
        i.path[-1][0] = True


def _box(i, args, values, scope):
    if v := _last(values, args, 4):
        x, y, w, h = v
        i.path.append([True, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], []])


def _painter(close: int, paint: int) -> Callable:
    def run(i, args, values, scope):
        if i.path:
            if close:
                i.path[-1][0] = True
            i._emit("path", scope[1], paint_op=paint, subpaths=[(c, list(p)) for c, p, _ in i.path])
        i.path = []

    return run


def _begin_text(i, args, values, scope):
    i.tm = i.lm = IDENTITY


def _font(i, args, values, scope):
    if len(args) >= 2 and isinstance(args[-2], Name):
        s = i.state
        s.font, s.font_size = i._resource(scope, "Font", args[-2]), number(args[-1], s.font_size)


def _mode(i, args, values, scope):
    if v := _last(values, args, 1):
        i.state.render_mode = int(v[0])


def _leading(i, args, values, scope):
    if v := _last(values, args, 1):
        i.state.leading = v[0]


def _next(i, args, values, scope):
    if v := _last(values, args, 2):
        i._line(*v)


def _next_leading(i, args, values, scope):
    if v := _last(values, args, 2):
        i.state.leading = -v[1]
        i._line(*v)


def _matrix(i, args, values, scope):
    if v := _last(values, args, 6):
        i.tm = i.lm = v


def _new_line(i, args, values, scope):
    i._line(0, -i.state.leading)


def _show(i, args, values, scope):
    if args and isinstance(args[-1], PdfString):
        i._show(args[-1], scope[1])


def _show_next(i, args, values, scope):
    if args and isinstance(args[-1], PdfString):
        i._line(0, -i.state.leading)
        i._show(args[-1], scope[1])


def _show_all(i, args, values, scope):
    if args and isinstance(args[-1], list):
        for x in args[-1]:
            if isinstance(x, PdfString):
                i._show(x, scope[1])


def _do(i, args, values, scope):
    if args and isinstance(args[-1], Name):
        i._xobject(scope, args[-1])


def _mark(i, args, values, scope):
    i.tags.append({"role": str(args[-1]), "props": None} if args and isinstance(args[-1], Name) else None)


def _mark_properties(i, args, values, scope):
    ok = len(args) >= 2 and isinstance(args[-2], Name)
    props = i._resource(scope, "Properties", args[-1]) if ok and isinstance(args[-1], Name) else args[-1] if args else None
    i.tags.append({"role": str(args[-2]), "props": layer_name(i.doc, props)} if ok else None)


def _end_mark(i, args, values, scope):
    if i.tags:
        i.tags.pop()


def _inline(i, args, values, scope):
    d = args[-1]
    i._emit("image", scope[1], img_w=integer(d.get("Width"), 0), img_h=integer(d.get("Height"), 0), inline=True)


ACTIONS: dict[bytes, Callable] = {
    b"q": _save, b"Q": _restore, b"cm": _concat, b"w": _width, b"gs": _state, b"m": _move, b"l": _to, b"c": _c, b"v": _v, b"y": _y, b"h": _close, b"re": _box,
    b"BT": _begin_text, b"Tf": _font, b"Tr": _mode, b"TL": _leading, b"Td": _next, b"TD": _next_leading, b"Tm": _matrix, b"T*": _new_line, b"Tj": _show, b"'": _show_next, b'"': _show_next, b"TJ": _show_all,
    b"Do": _do, b"BMC": _mark, b"BDC": _mark_properties, b"EMC": _end_mark, b"BI": _inline,
} | {op: _painter(*how) for op, how in PAINT.items()}


def curve_points(a: tuple, b: tuple, c: tuple, d: tuple, steps: int = CURVE_STEPS) -> list[tuple]:
    out = []
    for k in range(1, steps + 1):
        t = k / steps
        u = 1 - t
        out.append(tuple(u * u * u * p + 3 * u * u * t * q + 3 * u * t * t * r + t * t * t * s for p, q, r, s in zip(a, b, c, d)))
    return out


def layer_name(doc: Document, props: Any) -> str | None:
    """What a property list names: the layer's name, if it has one."""
    n = doc.get(props.get("Name")) if isinstance(props, dict) else None
    return n.text if isinstance(n, PdfString) else str(n) if isinstance(n, Name) else None


def inline_image(r: Reader) -> dict:
    """The dictionary of an inline image, abbreviations written out; leaves the reader after EI."""
    d: dict = {}
    while (key := r.token()) is not END and key != b"ID":
        if isinstance(key, Name):
            value = r.object()
            key = INLINE_KEYS.get(key, str(key))
            names = SHORT if key == "Filter" else INLINE_SPACES if key == "ColorSpace" else {}
            long = lambda v: Name(names.get(v, v)) if isinstance(v, Name) else v
            d[key] = [long(v) for v in value] if isinstance(value, list) else long(value)
    at = r.pos + 1
    while (at := r.data.find(b"EI", at, r.end)) >= 0:
        if r.data[at - 1] in SPACE and (at + 2 >= r.end or r.data[at + 2] in SPACE + b"Qq"):
            r.pos = at + 2
            return d
        at += 2
    r.pos = r.end
    return d


#: A line of names, numbers, words and plain strings: read alone, it says what it says in its place, if an operator ends it.
_alone = re.compile(rb"[ \t]*+(?:(?:/?+[^\0\t\n\f\r ()<>\[\]{}/%]++|\([^()\\\r]*+\))[ \t]*+)*+\Z")
_marked = re.compile(rb"[()\\\r]")
LINES, LINE_BYTES = 8192, 256


@lru_cache(maxsize=LINES)
def _line(line: bytes) -> tuple | None:
    """The operators of a line that stands alone, as operators() gives them; None for any other."""
    if not _alone.match(line):
        return None
    out = tuple((op, tuple(args), *more) for op, args, *more in _read(Reader(line)))
    if (out[-1][3] if out else 0) < len(line.rstrip(b" \t")) or any(x[0] in (b"BI", b"ID", b"EI") for x in out):
        return None
    return out


def _values(operands: list) -> tuple | None:
    if not all(type(v) is int or type(v) is float for v in operands):
        return None
    try:
        return tuple(map(float, operands))
    except OverflowError:
        return None


def _read(r: Reader, line: bool = False) -> Iterator[tuple[bytes, list, int, int, tuple | None, Callable | None]]:
    """Operators as they come; with line, up to one that ends where a line does."""
    operands, begin = [], None
    while True:
        r.skip()
        at = r.pos
        x = r.object()
        if x is END:
            return
        begin = at if begin is None else begin
        if not isinstance(x, Keyword):
            operands.append(x)
            if len(operands) > OPERANDS:
                del operands[0]
            continue
        if x == b"BI":
            operands.append(inline_image(r))
        yield bytes(x), operands, begin, r.pos, _values(operands), ACTIONS.get(x)
        operands, begin = [], None
        if line and r.data[r.pos : r.pos + 1] == b"\n":
            return


def operators(content: bytes) -> Iterator[tuple[bytes, list | tuple, int, int, tuple | None, Callable | None]]:
    """(operator, its last operands, where the first begins, where the operator ends, the operands' values if all are numbers, what interprets it).

    An inline image is an operand of its BI. Lines that stand alone are read once, wherever they come again.
    """
    at, size = 0, len(content)
    while at < size:
        end = content.find(b"\n", at)
        end = size if end < 0 else end
        if content[at] == 0x28 and content.endswith(b") Tj", at, end) and not _marked.search(content, at + 1, end - 4):
            yield b"Tj", (PdfString(content[at + 1 : end - 4]),), at, end, None, _show
        elif end - at <= LINE_BYTES and (known := _line(content[at:end])) is not None:
            for op, args, first, last, values, act in known:
                yield op, args, at + first, at + last, values, act
        else:
            r = Reader(content, at)
            yield from _read(r, True)
            end = r.pos
        at = end + 1


#: Content of up to so many bytes is read as a list.
PROGRAM_BYTES = 1 << 16


def program(content: bytes) -> Iterable[tuple]:
    """operators() for those who need no places."""
    if len(content) > PROGRAM_BYTES:
        return operators(content)
    out: list[tuple] = []
    for line in content.split(b"\n"):
        if line[-4:] == b") Tj" and line[0] == 0x28 and not _marked.search(line, 1, len(line) - 4):
            out.append((b"Tj", (PdfString(line[1:-4]),), 0, 0, None, _show))
        elif len(line) > LINE_BYTES or (known := _line(line)) is None:
            return operators(content)
        else:
            out += known
    return out


def flatten_layers(content: bytes, properties: dict[str, str], hidden: Callable[[str], bool]) -> bytes:
    """Content without the optional-content blocks of hidden layers, and without the marks of visible ones; other bytes stay.

    properties: layer names by property name.
    """
    out, at, stack, dark = bytearray(), 0, [], 0
    for op, args, begin, end, _, _ in operators(content):
        if op in (b"BDC", b"BMC"):
            layer = properties.get(str(args[-1])) if op == b"BDC" and len(args) >= 2 and args[-2] == "OC" and isinstance(args[-1], Name) else None
            kind = None if layer is None else "hidden" if hidden(layer) else "visible"
            if not dark and kind:
                out += content[at:begin]
                at = end
            dark += kind == "hidden"
            stack.append(kind)
        elif op == b"EMC" and stack:
            kind = stack.pop()
            dark -= kind == "hidden"
            if kind and not dark:
                if kind == "visible":
                    out += content[at:begin]
                at = end
    if not dark:
        out += content[at:]
    return bytes(out)
