"""Import, merge, and deduplication of objects across documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache
from typing import Any

from foliospark.kernels.document import Document, Page
from foliospark.kernels.objects import Name, Ref, Stream
from foliospark.kernels.writer import _HOLDERS, Builder, Written, box_array, value_bytes

COLLAPSE = 128
INHERITED = ("MediaBox", "CropBox", "Resources", "Rotate")


def structural_hash(x: Any, get, memo: dict[int, str | None] | None = None) -> str | None:
    """Hash of an object graph: dictionaries by sorted key, lengths left out; None for a graph with a cycle.

    memo keeps the hashes of a document's objects by number, so that shared objects are walked once; an object under way counts as None, and one that reaches it lies on a cycle too.
    """
    memo = {} if memo is None else memo
    if isinstance(x, Ref):
        if x.num not in memo:
            memo[x.num] = None
            memo[x.num] = structural_hash(get(x), get, memo)
        return memo[x.num]
    if isinstance(x, Stream):
        inner = structural_hash({k: v for k, v in x.dict.items() if k != "Length"}, get, memo)
        return None if inner is None else hashlib.sha256(f"stream {inner} {hashlib.sha256(x.raw).hexdigest()}".encode()).hexdigest()
    if isinstance(x, dict):
        parts = [(k, structural_hash(v, get, memo)) for k, v in sorted(x.items()) if k != "Length"]
        said = None if any(h is None for _, h in parts) else "<<" + " ".join(f"{k} {h}" for k, h in parts) + ">>"
    elif isinstance(x, list):
        items = [structural_hash(v, get, memo) for v in x]
        said = None if None in items else "[" + " ".join(items) + "]"
    else:
        said = value_bytes(x).decode("latin-1")
    return said if said is None or len(said) <= COLLAPSE else hashlib.sha256(said.encode()).hexdigest()


#: Values whose notation is one and is equal if they are.
_PLAIN = {Name, int}
#: Notations of so many objects are kept, with the objects, which nobody changes.
NOTATIONS = 4096
_notations: dict[int, tuple[dict, list[bytes], list[Ref]]] = {}


@lru_cache(maxsize=NOTATIONS)
def _box_bytes(box: tuple) -> bytes:
    return value_bytes(box_array(box))


def _notation(x: dict) -> tuple[list[bytes], list[Ref]]:
    known = _notations.get(id(x))
    if known is None:
        if len(_notations) >= NOTATIONS:
            _notations.clear()
        w = Written.of(x)
        known = _notations[id(x)] = x, w.parts, w.refs
    return known[1:]


class Importer:
    """Copies pages of other documents into a builder; equal streams are kept once if dedup is set."""

    def __init__(self, target: Builder, dedup: bool = True):
        self.target, self.dedup = target, dedup
        self.by_hash: dict[tuple[str | tuple, bytes], Ref] = {}
        self.copies: dict[tuple[int, int], Ref] = {}
        self.forms: dict[tuple[int, int], Ref] = {}
        self.sources: list[Document] = []
        self.memos: list[dict[int, str | None]] = []

    def _source(self, doc: Document) -> int:
        if self.sources and self.sources[-1] is doc:
            return len(self.sources) - 1
        for k, d in enumerate(self.sources):
            if d is doc:
                return k
        self.sources.append(doc)
        self.memos.append({})
        return len(self.sources) - 1

    def copy(self, doc: Document, x: Any) -> Any:
        kind = type(x)
        if kind is Ref:
            return self._shared(doc, x)
        if kind is dict:
            return {k: self.copy(doc, v) if type(v) in _HOLDERS else v for k, v in x.items()}
        if kind is list:
            return [self.copy(doc, v) if type(v) in _HOLDERS else v for v in x]
        if isinstance(x, Stream):
            return Stream({k: self.copy(doc, v) for k, v in x.dict.items() if k != "Length"}, x.raw)
        return x

    def _shared(self, doc: Document, ref: Ref) -> Ref | None:
        key = self._source(doc), ref.num
        if key in self.copies:
            return self.copies[key]
        x = doc.get(ref)
        if x is None:
            return None
        if doc.shape and type(x) is dict:
            self.copies[key] = out = self.target.add(None)
            self.target.put(out, self._written(doc, x))
            return out
        h = None
        if self.dedup and isinstance(x, Stream):
            own = {k: v for k, v in x.dict.items() if k != "Length"}
            plain = all(type(v) in _PLAIN for v in own.values())
            inner = tuple(sorted(own.items())) if plain else structural_hash(own, doc.get, self.memos[key[0]])
            h = None if inner is None else (inner, x.raw)
        if h is not None and h in self.by_hash:
            self.copies[key] = self.by_hash[h]
            return self.by_hash[h]
        self.copies[key] = out = self.target.add(None)
        if h is not None:
            self.by_hash[h] = out
        self.target.put(out, self.copy(doc, x))
        return out

    def _written(self, doc: Document, x: dict) -> Written:
        """A copy of a dictionary that documents share, put into file notation once."""
        parts, refs = _notation(x)
        return Written(parts, [self._shared(doc, r) for r in refs])

    def made(self, page: Page) -> Ref:
        """page(), for a target that nobody looks into before it is saved: what documents share is written in file notation once."""
        doc = page.doc
        if not doc.shape or doc.shape.pages is None or "Annots" in page.dict:
            return self.page(page)
        memo = doc.shape.memo
        if ("page", page.num) not in memo:
            whole = {k: page.inherited[k] for k in INHERITED if k in page.inherited} | page.dict
            memo["page", page.num] = {k: v for k, v in whole.items() if k != "Parent"} | {"Parent": Ref(0)}
        parts, refs = _notation(memo["page", page.num])
        return self.target.append_made(Written(parts, [*(self._shared(doc, r) for r in refs[:-1]), self.target.tree]))

    def page(self, page: Page) -> Ref:
        """The page at the end of the target, what it inherits written out; its annotations belong to the new page."""
        doc = page.doc
        whole = {k: page.inherited[k] for k in INHERITED if k in page.inherited} | page.dict
        annotations = [x for x in page.annotations()]
        d = {k: self.copy(doc, v) for k, v in whole.items() if k not in ("Parent", "Annots")}
        ref = self.target.append(d)
        if annotations:
            copied = [self.copy(doc, {k: v for k, v in a.items() if k not in ("P", "Parent", "Popup")}) | {"P": ref} for a in annotations]
            self.target.put(ref, self.target.get(ref) | {"Annots": [self.target.add(a) for a in copied]})
        return ref

    def form(self, page: Page, box: tuple | None = None) -> Ref:
        """The page as a form, its box the crop box; rotation isn't applied."""
        key = self._source(page.doc), page.num
        if key not in self.forms:
            box, own = box or page.box("CropBox") or page.box("MediaBox") or (0, 0, 612, 792), page.own("Resources")
            d = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": Written([_box_bytes(box)], []) if page.doc.shared else box_array(box), "Resources": self._written(page.doc, own) if page.doc.shared and type(own) is dict else self.copy(page.doc, own or {})}
            c = page.doc.get(page.dict.get("Contents"))
            if isinstance(c, Stream) and c.dict.keys() <= {"Filter", "Length"} and c.dict.get("Filter") == "FlateDecode":
                self.forms[key] = self.target.add(Stream(d | {"Filter": c.dict["Filter"]}, c.raw))  # deflated as it is
            else:
                self.forms[key] = self.target.add(Stream(d, page.content()))
        return self.forms[key]


def merge(documents: Iterable[bytes], dedup: bool = True, object_streams: bool = False) -> bytes:
    target = Builder()
    importer = Importer(target, dedup)
    for data in documents:
        for page in Document(data, shared=True).pages():
            importer.made(page)
    return target.save(object_streams)


def impose(documents: list[bytes], columns: int, rows: int, sheet: tuple[float, float] = (612.0, 792.0)) -> bytes:
    """All pages, columns x rows to a sheet, each scaled into its cell."""
    target = Builder()
    importer = Importer(target)
    pages = [p for data in documents for p in Document(data, shared=True).pages()]
    w, h = sheet[0] / columns, sheet[1] / rows
    for at in range(0, len(pages), columns * rows):
        parts, names = [], {}
        for k, page in enumerate(pages[at : at + columns * rows]):
            x, y, pw, ph = box = page.box("CropBox") or page.box("MediaBox") or (0, 0, 612, 792)
            s = min(w / max(pw, 1e-6), h / max(ph, 1e-6))
            cx, cy = k % columns * w - x * s, sheet[1] - (k // columns + 1) * h - y * s
            names[Name(f"P{k}")] = importer.form(page, box)
            parts.append(b"q %.4f 0 0 %.4f %.4f %.4f cm /P%d Do Q" % (s, s, cx, cy, k))
        target.add_page((0, 0, *sheet), b"\n".join(parts), {"XObject": names})
    return target.save()
