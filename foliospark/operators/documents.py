"""Tables of a collection of documents. Every function takes rows with doc_id and content BINARY and gives rows; damage never fails a task.

Filter doc_id, path and length before these: Catalyst pushes no predicate through a kernel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.kernels import filters, images, inspect
from foliospark.kernels.content import Interpreter, layer_name
from foliospark.kernels.document import Document, Page
from foliospark.kernels.importer import structural_hash
from foliospark.kernels.objects import Name, PdfString, Ref, Stream, integer
from foliospark.kernels.syntax import END, Reader
from foliospark.kernels.writer import value_bytes
from foliospark.operators.rows import kernel

BOX = "struct<x:double,y:double,w:double,h:double>"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def _open(content: bytes | None) -> Document | None:
    """A document that is only read."""
    try:
        return Document(content or b"", shared=True)
    except Exception:  # noqa: BLE001 - any damage becomes a row's parse_error
        return None


def _matrix(m: tuple | None) -> dict | None:
    return dict(zip("abcdef", map(float, m))) if m else None


def _box(b: tuple | None) -> dict | None:
    return dict(zip("xywh", b)) if b else None


def pdf_docs(df: DataFrame) -> DataFrame:
    """A row per document: version, encryption, recovery, object and page counts, information; parse_error where nothing could be read."""

    def facts(doc_id, content):
        d = _open(content)
        if d is None:
            yield doc_id, None, None, None, None, None, None, None, None, "unreadable"
            return
        try:
            text = lambda k: x.text if isinstance(x := d.get(d.info.get(k)), PdfString) else None
            pages = d.pages()
            yield doc_id, d.version, d.encrypted, d.recovered, d.reason, d.max_object, len(pages), text("Creator"), text("Producer"), None if d.catalog else "no catalog"
        except Exception as e:  # noqa: BLE001
            yield doc_id, None, d.encrypted, d.recovered, d.reason, None, None, None, None, f"{type(e).__name__}: {e}"[:200]

    kind = df.schema["doc_id"].dataType.simpleString()
    return kernel(df, facts, f"doc_id {kind}, version string, is_encrypted boolean, used_recovery_scan boolean, recovery_reason string, max_object_number int, page_count int, creator string, producer string, parse_error string", ["doc_id", "content"])


def _table(df: DataFrame, schema: str, rows) -> DataFrame:
    def run(doc_id, content):
        d = _open(content)
        if d is None:
            return
        try:
            yield from ((doc_id, *r) for r in rows(d))
        except Exception:  # noqa: BLE001 - the rows before it stand; content_errors() has the error
            return

    return kernel(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {schema}", ["doc_id", "content"])


def xref_entries(df: DataFrame) -> DataFrame:
    """Entries of every section as read, newest section first; newest_entries() picks what holds."""

    def rows(d: Document):
        for section, num, e in d.listed:
            yield num, e.kind, None if e.kind == 2 else e.offset, e.offset if e.kind == 2 else None, section

    return _table(df, "obj_num int, entry_type int, offset bigint, stream_obj int, section_ord int", rows)


def newest_entries(entries: DataFrame) -> DataFrame:
    """The first entry of each object, by section."""
    value = F.struct("entry_type", "offset", "stream_obj", "section_ord")
    return entries.groupBy("doc_id", "obj_num").agg(F.min_by(value, "section_ord").alias("e")).select("doc_id", "obj_num", "e.*")


def to_json(x: Any) -> Any:
    """A direct object as JSON, names and references tagged."""
    if isinstance(x, Name):
        return {"name": str(x)}
    if isinstance(x, Ref):
        return {"ref": x.num}
    if isinstance(x, PdfString):
        return x.text
    if isinstance(x, bytes):
        return x.decode("latin-1")
    if isinstance(x, dict):
        return {k: to_json(v) for k, v in x.items()}
    if isinstance(x, list):
        return [to_json(v) for v in x]
    return x


def _chosen(types: dict[str, str], columns: list[str] | None) -> tuple[list[str], str]:
    """The columns asked for, or all, and their schema: a kernel makes no others, and Catalyst can't tell it which are read."""
    names = list(types) if columns is None else columns
    return names, ", ".join(f"{n} {types[n]}" for n in names)


OBJECTS = {"obj_num": "int", "kind": "string", "value_json": "string", "raw": "binary", "filters": "array<string>"}
_kinds = {Stream: "stream", dict: "dict", list: "array", bool: "boolean", int: "number", float: "number", Name: "name", PdfString: "string", Ref: "reference"}
_object_values = {
    "obj_num": lambda d, num, x: num,
    "kind": lambda d, num, x: _kinds.get(type(x), "other"),
    "value_json": lambda d, num, x: json.dumps(to_json(x.dict if isinstance(x, Stream) else x)),
    "raw": lambda d, num, x: x.raw if isinstance(x, Stream) else None,
    "filters": lambda d, num, x: [n for n, _ in filters.chain(x.dict, d.get)] if isinstance(x, Stream) else None,
}


def cos_objects(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every live object: its kind, its value as JSON (variant_get after parse_json), and of streams the bytes and filters; all columns, or those named."""
    names, schema = _chosen(OBJECTS, columns)
    take = [_object_values[n] for n in names]

    def rows(d: Document):
        for num in sorted(d.entries):
            if (x := d.object(num)) is not None:
                yield tuple([f(d, num, x) for f in take])

    return _table(df, schema, rows)


def structural_hashes(df: DataFrame) -> DataFrame:
    """A hash of every stream and what it refers to, equal for equal graphs in whatever document; null for a graph with a cycle. Grouping by it finds what a merge would keep once."""

    def rows(d: Document):
        memo: dict = {}
        for num in sorted(d.entries):
            x = d.object(num)
            if isinstance(x, Stream):
                yield num, structural_hash(Ref(num), d.get, memo), len(x.raw)

    return _table(df, "obj_num int, hash string, n_bytes bigint", rows)


def _edges(x: Any, path: str) -> Iterator[tuple[str, int]]:
    if isinstance(x, Ref):
        yield path, x.num
    elif isinstance(x, Stream):
        yield from _edges({k: v for k, v in x.dict.items() if k != "Length"}, path)
    elif isinstance(x, dict):
        for k, v in x.items():
            yield from _edges(v, f"{path}/{k}")
    elif isinstance(x, list):
        for k, v in enumerate(x):
            yield from _edges(v, f"{path}[{k}]")


def cos_edges(df: DataFrame) -> DataFrame:
    """References between objects; src_obj 0 is the trailer."""

    def rows(d: Document):
        for path, dst in _edges({k: v for k, v in d.trailer.items() if k in ("Root", "Info")}, ""):
            yield 0, path, dst
        for num in sorted(d.entries):
            for path, dst in _edges(d.object(num), ""):
                yield num, path, dst

    return _table(df, "src_obj int, path string, dst_obj int", rows)


def reachable(edges: DataFrame) -> DataFrame:
    """(doc_id, obj_num): objects that the trailer reaches; the edges of a document come together, as its objects do in a file."""

    def run(doc_id, pairs):
        out: dict[int, list[int]] = {}
        for p in pairs:
            out.setdefault(p["src_obj"], []).append(p["dst_obj"])
        seen, todo = set(), [0]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        yield from ((doc_id, n) for n in sorted(seen))

    grouped = edges.groupBy("doc_id").agg(F.collect_set(F.struct("src_obj", "dst_obj")).alias("pairs"))
    return kernel(grouped, run, f"doc_id {edges.schema['doc_id'].dataType.simpleString()}, obj_num int")


def resolve(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges with the object that they lead to; a dangling one has nulls."""
    target = objects.select("doc_id", F.col("obj_num").alias("dst_obj"), F.col("kind").alias("dst_kind"), F.col("value_json").alias("dst_json"))
    return edges.join(target, ["doc_id", "dst_obj"], "left")


def pdf_pages(df: DataFrame, content: bool = False) -> DataFrame:
    """Pages in order, boxes as written (media and crop inherited); resolved_boxes() fills in what falls back. Content is decoded only if asked for."""

    def rows(d: Document):
        for k, p in enumerate(d.pages(), 1):
            boxes = [_box(p.box(f"{b}Box")) for b in ("Media", "Crop", "Trim", "Bleed", "Art")]
            yield k, p.num, *boxes, p.rotation, len(p.annotations()), p.content() if content else None

    boxes = ", ".join(f"{b}_box {BOX}" for b in ("media", "crop", "trim", "bleed", "art"))
    return _table(df, f"page_no int, obj_num int, {boxes}, rotation int, n_annotations int, content binary", rows)


def resolved_boxes(pages: DataFrame) -> DataFrame:
    """Media falls back on Letter, crop on media, the others on crop; has_* tell what was written."""
    letter = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(612.0).alias("w"), F.lit(792.0).alias("h"))
    out = pages.withColumns({f"has_{b}": F.col(f"{b}_box").isNotNull() for b in ("trim", "bleed", "art")})
    out = out.withColumn("media_box", F.coalesce("media_box", letter)).withColumn("crop_box", F.coalesce("crop_box", "media_box"))
    return out.withColumns({f"{b}_box": F.coalesce(f"{b}_box", "crop_box") for b in ("trim", "bleed", "art")})


def annotations(df: DataFrame) -> DataFrame:
    def rows(d: Document):
        text = lambda x: x.text if isinstance(x := d.get(x), PdfString) else None
        for k, p in enumerate(d.pages(), 1):
            for a in p.annotations():
                action = d.get(a.get("A"))
                yield k, str(d.get(a.get("Subtype"))), text(a.get("Contents")), text(a.get("T")), text(action.get("URI")) if isinstance(action, dict) else None

    return _table(df, "page_no int, subtype string, contents string, title string, uri string", rows)


OPS = {"page_no": "int", "seq": "int", "op": "string", "n_operands": "int", "depth": "int"}


def content_ops(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Operators of every page, those of forms with their depth."""
    names, schema = _chosen(OPS, columns)
    at = [list(OPS).index(n) for n in names]

    def rows(d: Document):
        decoders: dict = {}
        for k, p in enumerate(d.pages(), 1):
            i = Interpreter(d, keep_ops=True, decoders=decoders)
            i.page(p)
            for seq, (op, n, depth) in enumerate(i.ops):
                whole = k, seq, op, n, depth
                yield tuple([whole[c] for c in at])

    return _table(df, schema, rows)


EVENTS = {
    "page_no": "int", "seq": "int", "depth": "int", "kind": "string", "text": "string", "font_size": "double", "render_mode": "int", "ctm": MATRIX, "tm": MATRIX, "img_w": "int", "img_h": "int", "paint_op": "int", "line_width": "double",
    "subpaths": "array<struct<closed:boolean,pts:array<struct<x:double,y:double>>>>", "tags": "array<struct<role:string,props:string>>",
}


def _subpaths(e: dict) -> list | None:
    sub = e.get("subpaths")
    return None if sub is None else [{"closed": c, "pts": [{"x": x, "y": y} for x, y in pts]} for c, pts in sub]


#: Columns that aren't the event's value of their name.
_event_values = {"ctm": lambda e: _matrix(e["ctm"]), "tm": lambda e: _matrix(e.get("tm")), "subpaths": _subpaths}


def event_rows(d: Document, pages: list[Page], columns: list[str] | None = None) -> Iterator[tuple]:
    names = list(EVENTS) if columns is None else columns
    take = [(n, _event_values.get(n)) for n in names]
    decoders: dict = {}
    for k, p in enumerate(pages, 1):
        for e in Interpreter(d, decoders=decoders).page(p):
            e["page_no"] = k
            yield tuple([f(e) if f else e.get(n) for n, f in take])


def render_events(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text, image and path events of every page, in order; all columns, or those named."""
    names, schema = _chosen(EVENTS, columns)
    return _table(df, schema, lambda d: event_rows(d, d.pages(), names))


def with_dpi(events: DataFrame) -> DataFrame:
    """Placed size in points and effective resolution of images; null for what is placed under a hundredth of a point."""
    m = lambda c: F.col(f"ctm.{c}")
    w, h = F.sqrt(m("a") * m("a") + m("b") * m("b")), F.sqrt(m("c") * m("c") + m("d") * m("d"))
    return events.withColumns({"placed_w": w, "placed_h": h, "dpi_x": F.when(w > 0.01, F.col("img_w") / (w / 72)), "dpi_y": F.when(h > 0.01, F.col("img_h") / (h / 72))})


def low_resolution(events: DataFrame, dpi: float = 300) -> DataFrame:
    return with_dpi(events).where((F.col("kind") == "image") & ((F.col("dpi_x") < dpi) | (F.col("dpi_y") < dpi)))


def invisible_text(events: DataFrame) -> DataFrame:
    return events.where((F.col("kind") == "text") & (F.col("render_mode") == 3))


def content_errors(df: DataFrame) -> DataFrame:
    """A row for each document or page whose content can't be read to its end, and for each content stream that no filter here decodes."""

    def run(doc_id, content):
        d = _open(content)
        try:
            pages = d.pages() if d else []
        except Exception as e:  # noqa: BLE001
            d, pages = None, []
            yield doc_id, 0, f"{type(e).__name__}: {e}"[:200]
        else:
            if d is None:
                yield doc_id, 0, "unreadable"
        for k, p in enumerate(pages, 1):
            c = d.get(p.dict.get("Contents"))
            for x in c if isinstance(c, list) else [c]:
                s = d.get(x)
                if isinstance(s, Stream) and d.decoded(s) is None:
                    yield doc_id, k, "unsupported filter"
            try:
                Interpreter(d).page(p)
            except Exception as e:  # noqa: BLE001
                yield doc_id, k, f"{type(e).__name__}: {e}"[:200]

    return kernel(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, page_no int, error string", ["doc_id", "content"])


def spot_colors(df: DataFrame) -> DataFrame:
    return _table(df, "page_no int, spot string", lambda d: ((k, s) for k, p in enumerate(d.pages(), 1) for s in sorted(inspect.page_spots(p))))


def color_spaces(df: DataFrame) -> DataFrame:
    def rows(d: Document):
        for k, p in enumerate(d.pages(), 1):
            group = d.get(p.resources.get("ColorSpace"))
            for n, x in group.items() if isinstance(group, dict) else []:
                yield k, str(n), inspect.describe_space(d, x)

    return _table(df, "page_no int, name string, description string", rows)


def fonts(df: DataFrame) -> DataFrame:
    return _table(df, "page_no int, font string, is_embedded boolean", lambda d: ((k, *f) for k, p in enumerate(d.pages(), 1) for f in inspect.page_fonts(p)))


def image_payloads(df: DataFrame) -> DataFrame:
    """Every image object: its size, the extension of a file that could hold it, and its bytes (pixels where the filters can be undone)."""

    def rows(d: Document):
        for num in sorted(d.entries):
            x = d.object(num)
            if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                chain = filters.chain(x.dict, d.get)
                yield num, integer(d.get(x.dict.get("Width"))), integer(d.get(x.dict.get("Height"))), images.extension([n for n, _ in chain]), images.payload(x.raw, chain)

    return _table(df, "obj_num int, width int, height int, extension string, payload binary", rows)


def layers(df: DataFrame) -> DataFrame:
    """(page, property name, layer name) of the layers that pages use."""

    def rows(d: Document):
        for k, p in enumerate(d.pages(), 1):
            group = d.get(p.resources.get("Properties"))
            for n, x in group.items() if isinstance(group, dict) else []:
                yield k, str(n), layer_name(d, d.get(x))

    return _table(df, "page_no int, property string, layer string", rows)


def tokens(df: DataFrame, column: str = "content") -> DataFrame:
    """Kinds of the tokens of any bytes: doc_id, seq, token kind."""

    def run(doc_id, content):
        r, k = Reader(content or b""), 0
        while (t := r.token()) is not END:
            kind = "name" if isinstance(t, Name) else "string" if isinstance(t, PdfString) else "number" if isinstance(t, int | float) else "keyword"
            yield doc_id, k, kind, value_bytes(t).decode("latin-1") if kind != "keyword" else bytes(t).decode("latin-1")
            k += 1

    return kernel(df.select("doc_id", F.col(column).alias("content")), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, seq int, kind string, token string")
