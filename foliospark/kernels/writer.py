"""Bytes from objects: values, whole files, and a builder for new documents."""

from __future__ import annotations

import math
import re
import struct
from functools import lru_cache
from itertools import accumulate
from typing import Any

from foliospark.kernels import filters
from foliospark.kernels.document import Document
from foliospark.kernels.objects import Name, PdfString, Ref, Stream, text_string

OBJECTS_A_STREAM = 200
LEAST_COMPRESSED = 32
BINARY = b"%\xe2\xe3\xcf\xd3\n"

_odd = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")
_escaped = re.compile(rb"[()\\\r\n]")
_printable = bytes([9, 10, 13, *range(32, 127)])


def number_bytes(x: float, digits: int = 6) -> bytes:
    if isinstance(x, int):
        return str(x).encode()
    if x.is_integer():
        return b"%d" % x
    if math.isnan(x) or math.isinf(x):
        return b"0"
    out = f"{x:.{digits}f}".rstrip("0").rstrip(".")
    return b"0" if out in ("-0", "") else out.encode()


@lru_cache(maxsize=8192)
def name_bytes(x: str) -> bytes:
    return b"/" + _odd.sub(lambda m: b"#%02X" % m[0][0], x.encode("utf-8", "surrogatepass"))


def string_bytes(x: bytes) -> bytes:
    """Literal, or hexadecimal where more than a third isn't printable."""
    if len(x.translate(None, _printable)) * 3 > len(x):
        return b"<" + x.hex().upper().encode() + b">"
    if not _escaped.search(x):
        return b"(" + x + b")"
    out = re.sub(rb"[()\\]", lambda m: b"\\" + m[0], x).replace(b"\r", b"\\r").replace(b"\n", b"\\n")
    return b"(" + out + b")"


def value_bytes(x: Any, number_of=lambda r: r.num) -> bytes:
    """A value in file notation. number_of gives the number that a reference is written with; None writes null."""
    kind = type(x)
    if kind is Name:
        return name_bytes(x)
    if kind is int:
        return b"%d" % x
    if kind is Ref:
        n = number_of(x)
        return b"null" if n is None else b"%d 0 R" % n
    if kind is dict:
        return b"<<" + b"".join([name_bytes(k) + b" " + value_bytes(v, number_of) for k, v in x.items()]) + b">>"
    if kind is list or kind is tuple:
        return b"[" + b" ".join([value_bytes(v, number_of) for v in x]) + b"]"
    if kind is float:
        return number_bytes(x)
    if kind is Written:
        return x.bytes(number_of)
    if x is None:
        return b"null"
    if kind is bool:
        return b"true" if x else b"false"
    if isinstance(x, str):
        return string_bytes(text_string(x))
    if isinstance(x, bytes):
        return string_bytes(x)
    raise TypeError(f"no notation for {type(x).__name__}")


class Written:
    """A value in file notation, its references left open: bytes around them, and what they lead to (None for null)."""

    __slots__ = ("parts", "refs")

    def __init__(self, parts: list[bytes], refs: list[Ref | None]):
        self.parts, self.refs = parts, refs

    @classmethod
    def of(cls, x: Any) -> Written:
        parts, refs = [bytearray()], []

        def put(x: Any) -> None:
            kind = type(x)
            if kind is Ref:
                refs.append(x)
                parts.append(bytearray())
            elif kind is dict:
                parts[-1] += b"<<"
                for k, v in x.items():
                    parts[-1] += name_bytes(k) + b" "
                    put(v)
                parts[-1] += b">>"
            elif kind is list or kind is tuple:
                parts[-1] += b"["
                for k, v in enumerate(x):
                    parts[-1] += b" " if k else b""
                    put(v)
                parts[-1] += b"]"
            else:
                parts[-1] += value_bytes(x)

        put(x)
        return cls([bytes(v) for v in parts], refs)

    def bytes(self, number_of) -> bytes:
        out = [self.parts[0]]
        for r, part in zip(self.refs, self.parts[1:]):
            n = None if r is None else number_of(r)
            out += (b"null" if n is None else b"%d 0 R" % n, part)
        return b"".join(out)


def stream_parts(s: Stream, compress: bool) -> tuple[dict, bytes]:
    d, raw = {k: v for k, v in s.dict.items() if k != "Length"}, s.raw
    if compress and "Filter" not in d and len(raw) > LEAST_COMPRESSED and len(packed := filters.flate_encode(raw)) < len(raw):
        d, raw = d | {"Filter": Name("FlateDecode")}, packed
    return d | {"Length": len(raw)}, raw


#: What can hold a reference.
_HOLDERS = {Ref, dict, list, tuple, Stream, Written}


class Builder:
    """Objects by number. Starts empty with a catalog and a page tree, or as a copy of a loaded document's view."""

    def __init__(self, source: Document | None = None):
        self.source = source
        self.objects: dict[int, Any] = {}
        self._tree: dict | None = None
        self.version = "1.7" if source is None else source.version
        if source is None:
            self.last = 0
            self.tree = self.add({"Type": Name("Pages"), "Kids": [], "Count": 0})
            self.trailer: dict = {"Root": self.add({"Type": Name("Catalog"), "Pages": self.tree})}
        else:
            if source.encrypted:
                raise ValueError("an encrypted document can't be written")
            self.last = source.max_object
            self.trailer = {k: v for k, v in source.trailer.items() if k in ("Root", "Info", "ID")}
            self.tree = source.catalog.get("Pages")

    def add(self, x: Any) -> Ref:
        self.last += 1
        self.objects[self.last] = x
        return Ref(self.last)

    def get(self, x: Any) -> Any:
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects[x.num] if x.num in self.objects else self.source.object(x.num) if self.source else None
        return None

    def put(self, ref: Ref, x: Any) -> None:
        self.objects[ref.num] = x

    def ensure_indirect(self, x: Any) -> Ref:
        return x if isinstance(x, Ref) else self.add(x)

    def info(self, **entries: str) -> None:
        d = dict(self.get(self.trailer.get("Info")) or {}) | {k: text_string(v) for k, v in entries.items()}
        self.trailer["Info"] = self.add(d)

    def add_page(self, media: tuple[float, ...] = (0, 0, 612, 792), content: bytes = b"", resources: dict | None = None, **more: Any) -> Ref:
        """A page with box (x, y, width, height) at the end of the tree."""
        d = {"Type": Name("Page"), "Parent": self.tree, "MediaBox": box_array(media), "Resources": resources or {}, "Contents": self.add(Stream({}, content)), **more}
        return self.append(d)

    def append(self, d: dict) -> Ref:
        return self.append_made(d | {"Parent": self.tree})

    def append_made(self, x: Any) -> Ref:
        """A page that names its parent."""
        page = self.add(x)
        tree = self.get(self.tree)
        if tree is not self._tree:  # a view of the source's, or put by a caller: copied once, then grown in place
            tree = dict(tree) | {"Kids": list(self.get(tree.get("Kids")) or [])}
            self._tree = tree
            self.put(self.tree, tree)
        tree["Kids"].append(page)
        tree["Count"] = (tree.get("Count") or 0) + 1
        return page

    # -- saving --

    def reachable(self) -> list[tuple[Ref, Any]]:
        """Objects that the trailer reaches, in the order of their discovery."""
        order: dict[int, Any] = {}
        todo: list[Any] = [self.trailer]

        def refs(x: Any) -> list[Ref]:
            out, stack = [], [x]
            while stack:
                v = stack.pop()
                kind = type(v)
                if kind is Ref:
                    out.append(v)
                elif kind is Stream:
                    stack += [w for k, w in reversed(v.dict.items()) if k != "Length" and type(w) in _HOLDERS]
                elif kind is Written:
                    out += [r for r in v.refs if r is not None]
                elif isinstance(v, dict):
                    stack += [w for w in reversed(v.values()) if type(w) in _HOLDERS]
                else:
                    stack += [w for w in reversed(v) if type(w) in _HOLDERS]
            return out

        at = 0
        while at < len(todo):
            x = todo[at]
            for r in x.refs if type(x) is Written else refs(x):
                if r is not None and r.num not in order and (x := self.get(r)) is not None:
                    order[r.num] = x
                    if type(x) in _HOLDERS:
                        todo.append(x)
            at += 1
        return [(Ref(n), x) for n, x in order.items()]

    def save(self, object_streams: bool = False, compress: bool = True) -> bytes:
        found = self.reachable()
        new = {r.num: k for k, (r, _) in enumerate(found, 1)}
        number_of = lambda r: new.get(r.num)
        version = max(self.version, "1.5") if object_streams else self.version
        out = bytearray(b"%%PDF-%s\n" % version.encode() + BINARY)
        offsets: dict[int, int] = {}
        packed: dict[int, tuple[int, int]] = {}

        def body(num: int, x: Any) -> None:
            offsets[num] = len(out)
            out.extend(b"%d 0 obj\n" % num)
            if isinstance(x, Stream):
                d, raw = stream_parts(x, compress)
                out.extend(value_bytes(d, number_of) + b"\nstream\n" + raw + b"\nendstream")
            else:
                out.extend(value_bytes(x, number_of))
            out.extend(b"\nendobj\n")

        plain = []
        for k, (_, x) in enumerate(found, 1):
            if object_streams and not isinstance(x, Stream):
                plain.append((k, x))
            else:
                body(k, x)
        last = len(found)
        for at in range(0, len(plain), OBJECTS_A_STREAM):
            part = plain[at : at + OBJECTS_A_STREAM]
            last += 1
            texts = [value_bytes(x, number_of) for _, x in part]
            starts = list(accumulate((len(t) + 1 for t in texts[:-1]), initial=0))
            head = b" ".join(b"%d %d" % (num, s) for (num, _), s in zip(part, starts)) + b"\n"
            packed |= {num: (last, k) for k, (num, _) in enumerate(part)}
            body(last, Stream({"Type": Name("ObjStm"), "N": len(part), "First": len(head)}, head + b"\n".join(texts)))
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID")}
        if not object_streams:
            start = len(out)
            out += b"xref\n0 %d\n0000000000 65535 f \n" % (last + 1)
            for num in range(1, last + 1):
                out += b"%010d 00000 n \n" % offsets[num]
            out += b"trailer\n" + value_bytes({"Size": last + 1, **trailer}, number_of)
        else:
            start, num = len(out), last + 1
            rows = [struct.pack(">BIH", 0, 0, 65535)]
            for k in range(1, last + 1):
                rows.append(struct.pack(">BIH", 2, *packed[k]) if k in packed else struct.pack(">BIH", 1, offsets[k], 0))
            rows.append(struct.pack(">BIH", 1, start, 0))
            body(num, Stream({"Type": Name("XRef"), "Size": num + 1, "W": [1, 4, 2], "Index": [0, num + 1], **trailer}, b"".join(rows)))
        out += b"\nstartxref\n%d\n%%%%EOF\n" % start
        return bytes(out)


class Template:
    """A builder's file in which the content of one stream is left open at marks: fill() gives the bytes that save() would with that content.

    What is equal in all documents is written once: a document costs its own content and the table behind it.
    """

    def __init__(self, b: Builder, hole: Ref, mark: bytes | None = None):
        x = b.get(hole)
        self.content = [x.raw] if mark is None else x.raw.split(mark)
        if x.dict:
            raise ValueError("a template's stream has no entries of its own")
        found = b.reachable()
        new = {r.num: k for k, (r, _) in enumerate(found, 1)}
        number_of = lambda r: new.get(r.num)
        self.num, before, after = new[hole.num], [b"%%PDF-%s\n" % b.version.encode() + BINARY], []
        for k, (_, x) in enumerate(found, 1):
            if k == self.num:
                continue
            d, raw = stream_parts(x, True) if isinstance(x, Stream) else (x, None)
            text = value_bytes(d, number_of) + (b"" if raw is None else b"\nstream\n" + raw + b"\nendstream")
            (before if k < self.num else after).append(b"%d 0 obj\n%s\nendobj\n" % (k, text))
        starts = list(accumulate(map(len, before)))
        self.before, self.after, self.at = b"".join(before) + b"%d 0 obj\n" % self.num, b"".join(after), starts[-1]
        self.table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(found) + 1) + b"".join(b"%010d 00000 n \n" % at for at in starts)
        self.later = list(accumulate(map(len, after[:-1]), initial=0)) if after else []
        trailer = {k: v for k, v in b.trailer.items() if k in ("Root", "Info", "ID")}
        self.trailer = b"trailer\n" + value_bytes({"Size": len(found) + 1, **trailer}, number_of) + b"\nstartxref\n"

    def fill(self, *pieces: bytes) -> bytes:
        """The file whose stream has these pieces, one at each mark; of a template without marks its whole content."""
        if len(pieces) != max(1, len(self.content) - 1):
            raise ValueError("as many pieces as marks")
        if len(self.content) == 1:
            raw = pieces[0]
        else:
            raw = b"".join([v for pair in zip(self.content, pieces) for v in pair]) + self.content[-1]
        head = b"<</Length %d>>"
        if len(raw) > LEAST_COMPRESSED and len(packed := filters.flate_encode(raw)) < len(raw):
            head, raw = b"<</Filter /FlateDecode/Length %d>>", packed
        out = b"".join((self.before, head % len(raw), b"\nstream\n", raw, b"\nendstream\nendobj\n"))
        rest = b"".join([b"%010d 00000 n \n" % (len(out) + at) for at in self.later])
        return b"".join((out, self.after, self.table, rest, self.trailer, b"%d\n%%%%EOF\n" % (len(out) + len(self.after))))


def box_array(box: tuple[float, ...]) -> list[float]:
    x, y, w, h = box
    return [x, y, x + w, y + h]
