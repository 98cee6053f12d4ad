"""A document: cross-references, objects on demand, recovery, pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

from foliospark.kernels import filters
from foliospark.kernels.objects import Keyword, Name, Ref, Stream, integer, number
from foliospark.kernels.syntax import END, SPACE, Reader

HEADER_BYTES, TAIL_BYTES = 1024, 2048
REF_CHAIN, TREE_DEPTH = 32, 256
LETTER = (0.0, 0.0, 612.0, 792.0)
FREE, PLAIN, PACKED = 0, 1, 2

_header = re.compile(rb"%PDF-(\d\.\d)")
_object = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_row = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")


#: What can stand before an object: a part of it is skipped. Nothing (the end) is skipped too.
_BEFORE = SPACE + b"%"
_end = re.compile(rb"endobj|stream")
_rows = re.compile(rb"[\0\t\n\f\r ]*((?:\d{10} \d{5} [nf](?: \r| \n|\r\n))+)")
#: Objects of a collection are often equal, byte for byte: so many of up to so many bytes are parsed once in a process.
PARSED, PARSED_BYTES = 4096, 1024


@lru_cache(maxsize=PARSED)
def _parsed(body: bytes) -> tuple[Any, int, bool] | None:
    """The object that some bytes begin with, where it ends, and whether only space follows; None if it may go on behind them."""
    r = Reader(body + b"\nendobj")
    x = r.object()
    return (x, r.pos, not body[r.pos :].strip(SPACE)) if r.pos <= len(body) and type(x) in (dict, list) else None


def _fresh(x: Any) -> Any:
    """A copy of a parsed object that its owner may change."""
    if type(x) is dict:
        return {k: _fresh(v) if type(v) in (dict, list) else v for k, v in x.items()}
    return [_fresh(v) if type(v) in (dict, list) else v for v in x]


class Entry(NamedTuple):
    kind: int
    offset: int  # or, packed, the object stream's number
    index: int = 0  # generation, or place in the object stream


#: So many shapes of up to so many bytes are kept in a process.
SHAPES, SHAPE_BYTES, SECTION_BYTES = 1024, 4096, 512
_finish = re.compile(rb"startxref\r?\n(\d{1,10})\r?\n%%EOF\s*\Z")
_table_rows = re.compile(rb"xref\r?\n0 \d+\r?\n((?:\d{10} \d{5} [nf](?: \r| \n|\r\n))+)trailer")


class Shape:
    """What documents share whose bytes differ in one object only, the last: cross-references, trailer and all other objects, parsed once."""

    def __init__(self, d: Document, hole: int):
        self.entries, self.listed, self.trailer, self.hole = d.entries, d.listed, d.trailer, hole
        self.objects = {n: x for n in d.entries if n != hole and (x := d.object(n)) is not None}
        d.cache.pop(hole, None)
        pages = d.pages()
        #: The page tree, if the last object has no part in it.
        self.pages = None if hole in d.cache else [(p.num, p.dict, p.inherited) for p in pages]
        #: What others derive from the shared objects.
        self.memo: dict = {}


@lru_cache(maxsize=SHAPES)
def _last(section: bytes) -> int | None:
    """The last offset in a table that is a document's only one."""
    m = _table_rows.match(section)
    offsets = [int(row[:10]) for row in m[1].splitlines() if row[17:18] == b"n"] if m else []
    return max(offsets, default=None)


@lru_cache(maxsize=SHAPES)
def _shape(before: bytes, section: bytes) -> Shape | None:
    """The shape of documents with these bytes before their last object and this table behind it; None if an object isn't read from them alone."""
    body = before + b"0 0 obj\nnull\nendobj\n"
    d = Document(b"%s%sstartxref\n%d\n%%%%EOF\n" % (body, section, len(body)), True, False)
    at = {e.offset: n for n, e in d.entries.items() if e.kind == PLAIN}
    if d.recovered or d.reason or len(at) != sum(e.kind == PLAIN for e in d.entries.values()) or len(before) not in at or {"Prev", "XRefStm", "Encrypt"} & set(d.trailer):
        return None
    hole = at.pop(len(before))
    for offset, n in at.items():
        m = _object.match(before, offset)
        end = _end.search(before, m.end()) if m and int(m[1]) == n else None
        if end is None or end[0] != b"endobj" or _parsed(before[m.end() : end.start()]) is None:
            return None
    d.cache = {}
    return Shape(d, hole)


def _shape_of(data: bytes) -> Shape | None:
    at = data.rfind(b"startxref", max(0, len(data) - TAIL_BYTES))
    m = _finish.match(data, at) if at >= 0 else None
    start = int(m[1]) if m else at
    if at - start > SECTION_BYTES or start >= at:
        return None
    section = data[start:at]
    last = _last(section)
    if last is None or last > SHAPE_BYTES or last >= start or (found := data.find(b"stream", 0, start)) >= 0 and found < last:
        return None
    return _shape(data[:last], section)


class Document:
    """Objects of a document that is shared belong to all documents that hold the same bytes: its owner only reads them."""

    def __init__(self, data: bytes, shared: bool = False, shaped: bool = True):
        self.data, self.shared = data, shared
        self.shape = shape = _shape_of(data) if shared and shaped else None
        if shape:
            self.entries, self.listed, self.trailer, self.cache = shape.entries, shape.listed, shape.trailer, dict(shape.objects)
            self.recovered, self.reason, self._scan, self._busy, self._packed = False, None, None, set(), {}
            return
        self.entries: dict[int, Entry] = {}
        #: (section, object, entry) of every section, newest first, as read.
        self.listed: list[tuple[int, int, Entry]] = []
        self.trailer: dict = {}
        self.recovered, self.reason = False, None
        self.cache: dict[int, Any] = {}
        self._scan: dict[int, int] | None = None
        self._busy: set[int] = set()
        self._packed: dict[int, dict[int, Any]] = {}
        try:
            self._sections()
        except (ValueError, IndexError, TypeError) as e:
            self.reason = str(e)[:200] or type(e).__name__
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self.reason = self.reason or "no catalog"
            self._rebuild()

    # -- header and cross-references --

    @property
    def header_version(self) -> str:
        m = _header.search(self.data[:HEADER_BYTES])
        return m[1].decode() if m else "1.4"

    @property
    def version(self) -> str:
        said = self.catalog.get("Version")
        return max(self.header_version, str(said)) if isinstance(said, Name) else self.header_version

    @property
    def encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    def _sections(self) -> None:
        tail = max(0, len(self.data) - TAIL_BYTES)
        at = self.data.rfind(b"startxref", tail)
        if at < 0:
            raise ValueError("no startxref")
        first = Reader(self.data, at + 9).token()
        if type(first) is not int:
            raise ValueError("startxref without an offset")
        todo, seen, section = [first], set(), 0
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if not 0 <= at < len(self.data):
                raise ValueError("cross-reference offset out of range")
            r = Reader(self.data, at)
            trailer = self._table(r, section) if r.token() == b"xref" else self._xref_stream(at, section)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            section += 1
            todo = [x for x in (integer(trailer.get("XRefStm")), integer(trailer.get("Prev"))) if x is not None] + todo

    def _add(self, section: int, num: int, entry: Entry) -> None:
        self.listed.append((section, num, entry))
        self.entries.setdefault(num, entry)

    def _table(self, r: Reader, section: int) -> dict:
        while True:
            first = r.token()
            if first == b"trailer":
                t = r.object()
                if not isinstance(t, dict):
                    raise ValueError("trailer isn't a dictionary")
                return t
            count = r.token()
            if type(first) is not int or type(count) is not int:
                raise ValueError("cross-reference section damaged")
            m = _rows.match(self.data, r.pos, r.pos + 20 * count + 8) if count > 0 else None
            if m and m.end() - m.start(1) == 20 * count:  # rows as they should be
                words = self.data[m.start(1) : m.end()].split()
                rows = zip(range(first, first + count), map(int, words[::3]), map(int, words[1::3]), words[2::3])
                found = {k: Entry(PLAIN, offset, index) if kind == b"n" else Entry(FREE, 0) for k, offset, index, kind in rows}
                self.listed += [(section, k, e) for k, e in found.items()]
                self.entries = found | self.entries
                r.pos = m.end()
                continue
            for k in range(count):
                m = _row.match(self.data, r.pos)
                if not m:
                    raise ValueError("cross-reference row damaged")
                r.pos = m.end()
                self._add(section, first + k, Entry(PLAIN, int(m[1]), int(m[2])) if m[3] == b"n" else Entry(FREE, 0))

    def _xref_stream(self, at: int, section: int) -> dict:
        s = self._at(at)
        if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
            raise ValueError("no cross-reference at its offset")
        widths = [integer(w, 0) for w in s.dict.get("W", [])]
        data = filters.decode(s.raw, filters.chain(s.dict))
        if len(widths) < 3 or data is None:
            raise ValueError("cross-reference stream damaged")
        index = s.dict.get("Index") or [0, integer(s.dict.get("Size"), 0)]
        a, b, c = widths[:3]
        pos = 0
        for first, count in zip(index[::2], index[1::2]):
            for k in range(count):
                row = data[pos : pos + a + b + c]
                if len(row) < a + b + c:
                    break
                pos += sum(widths)
                kind = int.from_bytes(row[:a]) if a else PLAIN
                if kind in (FREE, PLAIN, PACKED):
                    self._add(section, first + k, Entry(kind, int.from_bytes(row[a : a + b]), int.from_bytes(row[a + b :])))
        return s.dict

    # -- objects --

    def get(self, x: Any) -> Any:
        """x, or the object that it refers to; dangling and endless references are null."""
        if not isinstance(x, Ref):
            return x
        for _ in range(REF_CHAIN):
            x = self.cache[x.num] if x.num in self.cache else self.object(x.num)
            if not isinstance(x, Ref):
                return x
        return None

    def object(self, num: int) -> Any:
        if num in self.cache:
            return self.cache[num]
        if num in self._busy:
            return None
        self._busy.add(num)
        try:
            self.cache[num] = out = self._load(num)
        finally:
            self._busy.discard(num)
        return out

    def _load(self, num: int) -> Any:
        e = self.entries.get(num)
        if e is None or e.kind == FREE:
            return None
        if e.kind == PACKED:
            return self._members(e.offset).get(num)
        out = self._at(e.offset, num)
        if out is END:
            at = self.scanned().get(num)
            out = END if at is None else self._at(at, num)
        return None if out is END else out

    def _at(self, at: int, num: int | None = None) -> Any:
        """The object whose `n g obj` begins at an offset; END if there is none, or another number's."""
        data = self.data
        if self.shared and (m := _object.match(data, at)) and (num is None or int(m[1]) == num):
            begin = m.end()
            end = _end.search(data, begin, begin + PARSED_BYTES)
            known = _parsed(data[begin : end.start()]) if end else None
            if known and known[2]:  # what ends it follows at once
                x = known[0]
                if end[0] == b"endobj" or type(x) is not dict:
                    return x
                begin = end.end()
                begin += 2 if data.startswith(b"\r\n", begin) else data[begin : begin + 1] in (b"\n", b"\r")
                return Stream(x, self._stream_bytes(x, begin))
        r = Reader(data, at)
        if data[at : at + 1] in _BEFORE:
            r.skip()
        m = _object.match(self.data, r.pos)
        if not m or num is not None and int(m[1]) != num:
            return END
        r.pos = m.end()
        end = _end.search(self.data, r.pos, r.pos + PARSED_BYTES)
        known = _parsed(self.data[r.pos : end.start()]) if end else None
        if known:
            x = known[0] if self.shared else _fresh(known[0])
            r.pos += known[1]
        else:
            x = r.object()
        if isinstance(x, Keyword) or x is END:
            return None
        if isinstance(x, dict):
            if self.data[r.pos : r.pos + 1] in _BEFORE:
                r.skip()
            if self.data.startswith(b"stream", r.pos):
                begin = r.pos + 6
                begin += 2 if self.data.startswith(b"\r\n", begin) else self.data[begin : begin + 1] in (b"\n", b"\r")
                return Stream(x, self._stream_bytes(x, begin))
        return x

    def _stream_bytes(self, d: dict, begin: int) -> bytes:
        """Length bytes if endstream follows them, else up to the next endstream."""
        n = d.get("Length")
        if type(n) is int and n >= 0 and self.data.startswith(b"\nendstream", begin + n):
            return self.data[begin : begin + n]
        n = integer(self.get(n))
        if n is not None and 0 <= n <= len(self.data) - begin and self.data[begin + n : begin + n + 20].lstrip(SPACE).startswith(b"endstream"):
            return self.data[begin : begin + n]
        end = self.data.find(b"endstream", begin)
        if end < 0:
            end = self.data.find(b"endobj", begin)
        if end < 0:
            return self.data[begin:]
        if self.data[end - 2 : end] == b"\r\n":
            return self.data[begin : max(begin, end - 2)]
        return self.data[begin : max(begin, end - 1)] if self.data[end - 1 : end] in (b"\n", b"\r") else self.data[begin:end]

    def _members(self, stream: int) -> dict[int, Any]:
        """Objects of an object stream that the cross-references still place there."""
        if stream not in self._packed:
            self._packed[stream] = out = {}
            for num, x in self._unpack(self.object(stream)):
                e = self.entries.get(num)
                if e is not None and e.kind == PACKED and e.offset == stream:
                    out[num] = x
        return self._packed[stream]

    def _unpack(self, s: Any) -> Iterator[tuple[int, Any]]:
        if not isinstance(s, Stream):
            return
        data, n, first = self.decoded(s), integer(self.get(s.dict.get("N")), 0), integer(self.get(s.dict.get("First")), 0)
        if data is None:
            return
        r = Reader(data, 0, min(first, len(data)))
        head = []
        while len(head) < 2 * n and type(t := r.token()) is int:
            head.append(t)
        ends = [*head[3::2], len(data) - first]
        for num, offset, end in zip(head[::2], head[1::2], ends):
            body = data[first + offset : first + end] if self.shared and 0 < end - offset <= PARSED_BYTES else b""
            if known := _parsed(body) if body else None:
                yield num, known[0]
                continue
            x = Reader(data, first + offset).object()
            yield num, None if x is END or isinstance(x, Keyword) else x

    def decoded(self, s: Stream) -> bytes | None:
        d = s.dict
        if d.get("Filter") == "FlateDecode" and "DecodeParms" not in d and "DP" not in d:
            return filters.flate_decode(s.raw)
        return filters.decode(s.raw, filters.chain(d, self.get))

    # -- recovery --

    def scanned(self) -> dict[int, int]:
        """Offsets of every `n g obj` in the bytes; the last of a number counts."""
        if self._scan is None:
            self._scan = {int(m[1]): m.start() for m in _object.finditer(self.data)}
        return self._scan

    def _rebuild(self) -> None:
        self.recovered, self.cache, self._packed = True, {}, {}
        self.entries = {n: Entry(PLAIN, at) for n, at in self.scanned().items()}
        for num in list(self.entries):  # objects within object streams are found too
            x = self.object(num)
            if isinstance(x, Stream) and x.dict.get("Type") == "ObjStm":
                for k, (member, _) in enumerate(self._unpack(x)):
                    self.entries.setdefault(member, Entry(PACKED, num, k))
        self.cache = {}
        at = len(self.data)
        while (at := self.data.rfind(b"trailer", 0, at)) >= 0:
            t = Reader(self.data, at + 7).object()
            if isinstance(t, dict) and isinstance(self.get(t.get("Root")), dict):
                self.trailer = t
                return
        for num in sorted(self.entries, reverse=True):
            x = self.object(num)
            x = x.dict if isinstance(x, Stream) and x.dict.get("Type") == "XRef" else x
            if isinstance(x, dict) and x.get("Type") == "XRef" and isinstance(self.get(x.get("Root")), dict):
                self.trailer = x
                return
            if isinstance(x, dict) and x.get("Type") == "Catalog":
                self.trailer = {**self.trailer, "Root": Ref(num)}
                return

    # -- catalog and pages --

    @property
    def catalog(self) -> dict:
        x = self.get(self.trailer.get("Root"))
        return x if isinstance(x, dict) else {}

    @property
    def info(self) -> dict:
        x = self.get(self.trailer.get("Info"))
        return x if isinstance(x, dict) else {}

    @property
    def max_object(self) -> int:
        return max([0, integer(self.trailer.get("Size"), 1) - 1, *self.entries])

    def pages(self) -> list[Page]:
        if self.shape and self.shape.pages is not None:
            return [Page(self, *p) for p in self.shape.pages]
        out: list[Page] = []
        self._walk(self.catalog.get("Pages"), {}, set(), 0, out)
        if not out:
            for num in sorted(self.entries):
                x = self.object(num)
                if isinstance(x, dict) and x.get("Type") == "Page":
                    out.append(Page(self, num, x, self._climbed(x)))
        return out

    def _walk(self, node: Any, inherited: dict, seen: set, depth: int, out: list[Page]) -> None:
        num = node.num if isinstance(node, Ref) else 0
        d = self.get(node)
        if not isinstance(d, dict) or depth > TREE_DEPTH or num and num in seen:
            return
        seen.add(num)
        kids = self.get(d.get("Kids"))
        if d.get("Type") == "Page" or not isinstance(kids, list) and ("Contents" in d or "MediaBox" in d):
            out.append(Page(self, num, d, inherited))
            return
        inherited = inherited | {k: d[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in d}
        for kid in kids if isinstance(kids, list) else []:
            self._walk(kid, inherited, seen, depth + 1, out)

    def _climbed(self, d: dict) -> dict:
        out: dict = {}
        seen = 0
        while isinstance(d := self.get(d.get("Parent")), dict) and seen < TREE_DEPTH:
            out = {k: d[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in d} | out
            seen += 1
        return out


class Page:
    def __init__(self, doc: Document, num: int, d: dict, inherited: dict):
        self.doc, self.num, self.dict, self.inherited = doc, num, d, inherited

    def own(self, key: str) -> Any:
        return self.doc.get(self.dict.get(key, self.inherited.get(key)))

    def box(self, key: str) -> tuple[float, float, float, float] | None:
        """(x, y, width, height); only media and crop boxes are inherited."""
        return rectangle(self.doc, self.own(key) if key in ("MediaBox", "CropBox") else self.doc.get(self.dict.get(key)))

    @property
    def rotation(self) -> int:
        return int((number(self.own("Rotate"), 0.0) % 360) // 90 * 90)

    @property
    def resources(self) -> dict:
        x = self.own("Resources")
        return x if isinstance(x, dict) else {}

    def content(self) -> bytes:
        c = self.doc.get(self.dict.get("Contents"))
        if isinstance(c, Stream):
            return self.doc.decoded(c) or b""
        streams = [self.doc.get(x) for x in c] if isinstance(c, list) else []
        return b"\n".join(self.doc.decoded(s) or b"" for s in streams if isinstance(s, Stream))

    def annotations(self) -> list[dict]:
        a = self.doc.get(self.dict.get("Annots"))
        return [x for x in map(self.doc.get, a) if isinstance(x, dict)] if isinstance(a, list) else []


def rectangle(doc: Document, x: Any) -> tuple[float, float, float, float] | None:
    """A rectangle from two corners in any order."""
    if not isinstance(x, list) or len(x) < 4:
        return None
    c = [number(doc.get(v)) for v in x[:4]]
    if any(v is None for v in c):
        return None
    return min(c[0], c[2]), min(c[1], c[3]), abs(c[2] - c[0]), abs(c[3] - c[1])
