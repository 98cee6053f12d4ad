"""Content generation: a canvas, text helpers, layers, spot colours, annotations, and flow layout."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from foliospark.kernels import barcode, fonts, qr
from foliospark.kernels.objects import Name, PdfString, Ref, Stream, text_string
from foliospark.kernels.writer import Builder, box_array, name_bytes, number_bytes, string_bytes


def num(x: float) -> str:
    return number_bytes(float(x), 4).decode()


#: Left in a canvas where each document of a template has its own line.
MARK = b"\0\0mark\0\0"


def operation(name: str, *args: Any) -> bytes:
    """An operator with its operands."""
    words = [x if isinstance(x, bytes) else name_bytes(x) if isinstance(x, Name) else number_bytes(float(x), 4) for x in args]
    return b" ".join([*words, name.encode()])


def shown(text: str | bytes) -> bytes:
    return operation("Tj", string_bytes(fonts.encode(text) if isinstance(text, str) else text))


class Canvas:
    """Writes the content of one page or form and registers what it uses."""

    def __init__(self, target: Builder):
        self.target = target
        self.out = bytearray()
        self.resources: dict[str, dict] = {}
        self.annotations: list[dict] = []

    def op(self, name: str, *args: Any) -> Canvas:
        self.out += operation(name, *args) + b"\n"
        return self

    def raw(self, data: bytes) -> Canvas:
        self.out += data + b"\n"
        return self

    def register(self, kind: str, prefix: str, x: Any) -> Name:
        """The name of a resource; the same object gets the same name."""
        group = self.resources.setdefault(kind, {})
        for n, y in group.items():
            if y is x or y == x:
                return n
        name = Name(f"{prefix}{len(group)}")
        group[name] = x
        return name

    # state and paths

    def save(self):
        return self.op("q")

    def restore(self):
        return self.op("Q")

    def concat(self, *m: float):
        return self.op("cm", *m)

    def rectangle(self, x, y, w, h):
        return self.op("re", x, y, w, h)

    def move_to(self, x, y):
        return self.op("m", x, y)

    def line_to(self, x, y):
        return self.op("l", x, y)

    def curve_to(self, *p):
        return self.op("c", *p)

    def close(self):
        return self.op("h")

    def stroke(self):
        return self.op("S")

    def close_stroke(self):
        return self.op("s")

    def fill(self):
        return self.op("f")

    def fill_even_odd(self):
        return self.op("f*")

    def fill_stroke(self):
        return self.op("B")

    def clip(self):
        return self.op("W")

    def clip_even_odd(self):
        return self.op("W*")

    def end_path(self):
        return self.op("n")

    def line_width(self, w):
        return self.op("w", w)

    def dash(self, pattern: list[float], phase: float = 0):
        return self.op("d", b"[" + " ".join(map(num, pattern)).encode() + b"]", phase)

    # colours

    def fill_color(self, *c: float):
        return self.op({1: "g", 3: "rg", 4: "k"}[len(c)], *c)

    def stroke_color(self, *c: float):
        return self.op({1: "G", 3: "RG", 4: "K"}[len(c)], *c)

    def fill_separation(self, space: Any, tint: float):
        return self.op("cs", self.register("ColorSpace", "C", space)).op("scn", tint)

    def stroke_separation(self, space: Any, tint: float):
        return self.op("CS", self.register("ColorSpace", "C", space)).op("SCN", tint)

    # layers

    def begin_layer(self, layer: Ref):
        return self.op("BDC", Name("OC"), self.register("Properties", "L", layer))

    def end_layer(self):
        return self.op("EMC")

    # text

    def begin_text(self):
        return self.op("BT")

    def end_text(self):
        return self.op("ET")

    def font(self, font: str | dict | Ref, size: float):
        return self.op("Tf", self.register("Font", "F", fonts.standard_font(font) if isinstance(font, str) else font), size)

    def text_matrix(self, *m: float):
        return self.op("Tm", *m)

    def move_text(self, x, y):
        return self.op("Td", x, y)

    def leading(self, x):
        return self.op("TL", x)

    def render_mode(self, n: int):
        return self.op("Tr", n)

    def show(self, text: str | bytes):
        return self.raw(shown(text))

    def text(self, x: float, y: float, text: str, font: str = "Helvetica", size: float = 12):
        return self.begin_text().font(font, size).move_text(x, y).show(text).end_text()

    def aligned(self, text: str, x: float, y: float, font: str = "Helvetica", size: float = 12, align: str = "left", middle: bool = False, degrees: float = 0):
        """Text at a point, left, centred or right, set on its vertical middle if asked, turned about the point."""
        dx = -fonts.text_width(text, font, size) * {"left": 0, "center": 0.5, "right": 1}[align]
        a, d = fonts.vertical(font, size)
        dy = -(a + d) / 2 if middle else 0.0
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return self.begin_text().font(font, size).text_matrix(c, s, -s, c, x + dx * c - dy * s, y + dx * s + dy * c).show(text).end_text()

    def wrapped(self, text: str, x: float, y: float, w: float, h: float, font: str = "Helvetica", size: float = 12, leading: float | None = None) -> int:
        """Lines of a text in a box from its top; lines that don't fit are dropped. Returns how many were drawn."""
        step = leading if leading is not None else size * fonts.LINE
        a, _ = fonts.vertical(font, size)
        lines = wrap(text, w, font, size)[: max(0, int((h + 1e-6) // step))]
        for k, line in enumerate(lines):
            self.text(x, y + h - a - k * step, line, font, size)
        return len(lines)

    # objects

    def form(self, form: Ref, *m: float):
        return self.save().concat(*(m or (1, 0, 0, 1, 0, 0))).op("Do", self.register("XObject", "X", form)).restore()

    def image(self, image: Ref, x: float, y: float, w: float, h: float):
        return self.form(image, w, 0, 0, h, x, y)

    def image_fitted(self, image: Ref, x: float, y: float, w: float, h: float):
        """Centred in a rectangle, its proportions kept."""
        d = self.target.get(image).dict
        s = min(w / max(d["Width"], 1), h / max(d["Height"], 1))
        iw, ih = d["Width"] * s, d["Height"] * s
        return self.image(image, x + (w - iw) / 2, y + (h - ih) / 2, iw, ih)

    # results

    def page(self, media=(0, 0, 612, 792), **more: Any) -> Ref:
        if self.annotations:
            more["Annots"] = [self.target.add(a) for a in self.annotations]
        return self.target.add_page(media, bytes(self.out), self.resources, **more)

    def as_form(self, box: tuple) -> Ref:
        return self.target.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box_array(box), "Resources": self.resources}, bytes(self.out)))


def modules_form(target: Builder, rows: list[str], left: int, right: int, above: int, height: float = 1, gray: float = 0) -> Ref:
    """A form of the dark modules of rows of 0 and 1, one unit to a module, with its quiet zone within the box."""
    w, h = len(rows[0]) + left + right, len(rows) * height + 2 * above
    c = Canvas(target)
    c.fill_color(gray)
    for k, row in enumerate(rows):
        for run in re.finditer("1+", row):
            c.rectangle(run.start() + left, h - above - (k + 1) * height, len(run[0]), height)
    return c.fill().as_form((0, 0, w, h))


def qr_form(target: Builder, content: str, level: str = "M", gray: float = 0) -> Ref:
    """A QR code with its quiet zone of four modules."""
    return modules_form(target, qr.rows(content, level), 4, 4, 4, 1, gray)


def barcode_form(target: Builder, content: str, kind: str, height: float = 50, gray: float = 0) -> Ref:
    """A linear barcode with its quiet zones."""
    left, right = barcode.QUIET.get(kind, (10, 10))
    return modules_form(target, [barcode.encode(content, kind)], left, right, 0, height, gray)


def layer(target: Builder, name: str, visible: bool = True) -> Ref:
    """An optional-content group, listed in the catalog."""
    group = target.add({"Type": Name("OCG"), "Name": text_string(name)})
    root = target.trailer["Root"]
    catalog = dict(target.get(root))
    p = dict(target.get(catalog.get("OCProperties")) or {"OCGs": [], "D": {"Order": [], "ON": [], "OFF": []}})
    p["OCGs"] = [*p["OCGs"], group]
    d = dict(p["D"])
    d["Order"] = [*d.get("Order", []), group]
    key = "ON" if visible else "OFF"
    d[key] = [*d.get(key, []), group]
    target.put(root, catalog | {"OCProperties": p | {"D": d}})
    return group


def separation(target: Builder, name: str, c: float, m: float, y: float, k: float) -> Ref:
    """A spot colour whose tint scales a CMYK colour."""
    return target.add([Name("Separation"), Name(name), Name("DeviceCMYK"), {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0, 0], "C1": [c, m, y, k], "N": 1}])


def text_annotation(box: tuple, contents: str, title: str = "", icon: str = "Note", color: tuple = (1, 1, 0), opened: bool = False) -> dict:
    return {"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": box_array(box), "Contents": text_string(contents), "T": text_string(title), "Name": Name(icon), "C": list(color), "Open": opened}


def link_annotation(box: tuple, uri: str) -> dict:
    return {"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": box_array(box), "Border": [0, 0, 0], "A": {"S": Name("URI"), "URI": PdfString(uri.encode("ascii", "ignore"))}}


def wrap(text: str, width: float, font: str = "Helvetica", size: float = 12) -> list[str]:
    """Greedy lines: words by single spaces, a word too wide alone is split by character. Each \\n ends a line."""
    table, blank = fonts.widths(font), fonts.widths(font)[32]
    measure = lambda s: sum(map(table.__getitem__, fonts.encode(s)))
    room = width * 1000 / size + 1e-9 if size else math.inf
    out = []
    for paragraph in text.replace("\r\n", "\n").split("\n"):
        line, used = "", 0
        for word in paragraph.split(" "):
            w = measure(word)
            if used + (blank + w if line else w) <= room:
                line, used = (f"{line} {word}", used + blank + w) if line else (word, w)
                continue
            if line:
                out.append(line)
            line, used = "", 0
            for c in word:
                w = measure(c)
                if line and used + w > room:
                    out.append(line)
                    line, used = "", 0
                line, used = line + c, used + w
        out.append(line)
    return out


# ---- flow layout ----


@dataclass
class Paragraph:
    text: str
    font: str = "Helvetica"
    size: float = 12
    align: str = "left"
    leading: float = 1.35
    underline: bool = False
    link: str | None = None
    color: tuple = (0,)

    def lines(self, width: float) -> list[str]:
        return wrap(self.text, width, self.font, self.size)

    def height(self, width: float) -> float:
        return len(self.lines(width)) * self.size * self.leading

    def draw(self, c: Canvas, x: float, top: float, width: float) -> None:
        a, _ = fonts.vertical(self.font, self.size)
        for k, line in enumerate(self.lines(width)):
            w = fonts.text_width(line, self.font, self.size)
            at = x + (width - w) * {"left": 0, "center": 0.5, "right": 1}[self.align]
            y = top - k * self.size * self.leading - a
            c.fill_color(*self.color).text(at, y, line, self.font, self.size)
            if self.underline or self.link:
                c.line_width(self.size / 20).move_to(at, y - self.size / 10).line_to(at + w, y - self.size / 10).stroke()
            if self.link:
                c.annotations.append(link_annotation((at, y, w, self.size), self.link))


@dataclass
class Picture:
    image: Ref
    w: float
    h: float

    def height(self, width: float) -> float:
        return self.h

    def draw(self, c: Canvas, x: float, top: float, width: float) -> None:
        c.image_fitted(self.image, x, top - self.h, min(self.w, width), self.h)


@dataclass
class Rule:
    thickness: float = 1
    space: float = 4

    def height(self, width: float) -> float:
        return self.thickness + 2 * self.space

    def draw(self, c: Canvas, x: float, top: float, width: float) -> None:
        y = top - self.space - self.thickness / 2
        c.line_width(self.thickness).move_to(x, y).line_to(x + width, y).stroke()


@dataclass
class Cell:
    content: list
    colspan: int = 1
    padding: float = 2
    border: float = 0.5
    background: tuple | None = None

    def height(self, width: float) -> float:
        return sum(e.height(width - 2 * self.padding) for e in self.content) + 2 * self.padding

    def draw(self, c: Canvas, x: float, top: float, width: float, height: float) -> None:
        if self.background:
            c.fill_color(*self.background).rectangle(x, top - height, width, height).fill()
        if self.border:
            c.line_width(self.border).rectangle(x, top - height, width, height).stroke()
        y = top - self.padding
        for e in self.content:
            e.draw(c, x + self.padding, y, width - 2 * self.padding)
            y -= e.height(width - 2 * self.padding)


@dataclass
class Table:
    percents: list[float]
    cells: list[Cell] = field(default_factory=list)
    header_rows: int = 0

    def widths(self, width: float) -> list[float]:
        return [width * p / sum(self.percents) for p in self.percents]

    def rows(self) -> list[list[tuple[int, Cell]]]:
        """(column, cell) by row; a cell that doesn't fit goes to the next row, and spans no more columns than there are."""
        out: list[list[tuple[int, Cell]]] = [[]]
        at, n = 0, len(self.percents)
        for cell in self.cells:
            span = max(1, min(cell.colspan, n))
            if at + span > n:
                out.append([])
                at = 0
            out[-1].append((at, cell))
            at += span
        return [r for r in out if r]

    def span(self, widths: list[float], at: int, cell: Cell) -> float:
        return sum(widths[at : at + max(1, min(cell.colspan, len(widths)))])

    def row_height(self, row, widths: list[float]) -> float:
        return max(cell.height(self.span(widths, at, cell)) for at, cell in row)

    def height(self, width: float) -> float:
        w = self.widths(width)
        return sum(self.row_height(r, w) for r in self.rows())

    def draw_row(self, c: Canvas, row, x: float, top: float, w: list[float]) -> float:
        h = self.row_height(row, w)
        for at, cell in row:
            cell.draw(c, x + sum(w[:at]), top, self.span(w, at, cell), h)
        return h

    def draw(self, c: Canvas, x: float, top: float, width: float) -> None:
        w = self.widths(width)
        for row in self.rows():
            top -= self.draw_row(c, row, x, top, w)


class Flow:
    """Elements down a page; a new page where one doesn't fit but would on a fresh page. Tables break between rows and repeat headers."""

    def __init__(self, target: Builder, page=(612.0, 792.0), margin: float = 36):
        self.target, self.size, self.margin = target, page, margin
        self.canvas: Canvas | None = None
        self.n_pages = 0

    @property
    def width(self) -> float:
        return self.size[0] - 2 * self.margin

    def new_page(self) -> None:
        self.close()
        self.canvas, self.top = Canvas(self.target), self.size[1] - self.margin
        self.n_pages += 1

    def close(self) -> None:
        if self.canvas is not None:
            self.canvas.page((0, 0, *self.size))
        self.canvas = None

    def _fits(self, h: float) -> None:
        fresh = self.size[1] - 2 * self.margin
        if self.canvas is None or self.top - h < self.margin - 1e-6 and h <= fresh + 1e-6:
            self.new_page()

    def add(self, e) -> None:
        if isinstance(e, Table):
            return self._table(e)
        h = e.height(self.width)
        self._fits(h)
        e.draw(self.canvas, self.margin, self.top, self.width)
        self.top -= h

    def _table(self, t: Table) -> None:
        w, rows = t.widths(self.width), t.rows()
        head, body = rows[: t.header_rows], rows[t.header_rows :]
        for k, row in enumerate([*head, *body]):
            h = t.row_height(row, w)
            before = self.n_pages
            self._fits(h)
            if self.n_pages > before and k >= len(head) and before:
                for r in head:
                    self.top -= t.draw_row(self.canvas, r, self.margin, self.top, w)
            self.top -= t.draw_row(self.canvas, row, self.margin, self.top, w)
