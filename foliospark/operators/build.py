"""Documents from rows: generation, merging, imposition and rewriting, one output document per row or group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.kernels import content as C
from foliospark.kernels import importer
from foliospark.kernels.canvas import Canvas
from foliospark.kernels.document import Document, Page
from foliospark.kernels.objects import Stream
from foliospark.kernels.writer import Builder, Template
from foliospark.operators.rows import group_kernel, kernel


def generate(df: DataFrame, key: str, draw: Callable[[Builder, dict], None], object_streams: bool = False) -> DataFrame:
    """doc_id and content: draw(builder, row) makes the document of each row. Narrow."""
    names = list(df.columns)
    at = names.index(key)

    def run(*values):
        b = Builder()
        draw(b, dict(zip(names, values)))
        yield values[at], b.save(object_streams)

    return kernel(df, run, f"doc_id {df.schema[key].dataType.simpleString()}, content binary")


def page_of(draw: Callable[[Canvas, dict], None], media=(0, 0, 612, 792)) -> Callable[[Builder, dict], None]:
    """A document of one page."""

    def one(b: Builder, row: dict) -> None:
        c = Canvas(b)
        draw(c, row)
        c.page(media)

    return one


def grouped(df: DataFrame, key: str, order: list[str | Column], columns: list[str]) -> DataFrame:
    """key and rows, an array in order: partial lists shuffle, and a group is as large as its output document."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("rows"))


def merge(df: DataFrame, key: str, order: str, content: str = "content", dedup: bool = True, object_streams: bool = False) -> DataFrame:
    """The documents of each key, in order, as one; equal streams are kept once."""

    def run(k, rows):
        yield k, importer.merge((body for (body,) in rows), dedup, object_streams)

    named = df.select(F.col(key).alias("key"), F.col(order).alias("place"), F.col(content).alias("body"))
    return group_kernel(named, run, "key", ["place"], ["body"], f"doc_id {df.schema[key].dataType.simpleString()}, content binary")


def impose(df: DataFrame, columns: int, rows: int) -> DataFrame:
    """Pages of each document, columns x rows to a sheet."""
    return kernel(df, lambda k, c: [(k, importer.impose([c], columns, rows))], f"doc_id {df.schema['doc_id'].dataType.simpleString()}, content binary", ["doc_id", "content"])


def rewrite(df: DataFrame, change: Callable[[Builder, Document], None], object_streams: bool = False) -> DataFrame:
    """Each document changed and saved anew; an unreadable or encrypted one keeps its bytes."""

    def run(k, data):
        try:
            d = Document(data)
            b = Builder(d)
            change(b, d)
            yield k, b.save(object_streams)
        except (ValueError, TypeError, KeyError):
            yield k, data

    return kernel(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, content binary", ["doc_id", "content"])


def _layers(d: Document, page: Page) -> dict[str, str]:
    group = d.get(page.resources.get("Properties"))
    names = {str(n): C.layer_name(d, d.get(x)) for n, x in group.items()} if isinstance(group, dict) else {}
    return {n: x for n, x in names.items() if x is not None}


def _flat_template(d: Document) -> tuple[Template, dict[str, str]] | None:
    """The file around the content of a one-page document's only page and its layers' names, if its shape says both."""
    s = d.shape
    if s is None or s.pages is None or len(s.pages) != 1 or not s.pages[0][0]:
        return None
    if "flat" not in s.memo:
        (page,) = d.pages()
        b, names = Builder(d), _layers(d, page)
        content = b.add(Stream({}, b""))
        b.objects[page.num] = {**page.dict, "Contents": content}
        made = Template(b, content)
        s.memo["flat"] = None if s.hole in d.cache else (made, names)
    return s.memo["flat"]


def flatten_layers(df: DataFrame, hidden: Callable[[str], bool]) -> DataFrame:
    """Documents whose pages lack the content of hidden layers; an unreadable or encrypted one keeps its bytes."""

    def run(k, data):
        try:
            d = Document(data, shared=True)
            if known := _flat_template(d):
                template, names = known
                out = template.fill(C.flatten_layers(d.pages()[0].content(), names, hidden))
            else:
                b = Builder(d)
                for p in d.pages():
                    b.objects[p.num] = {**p.dict, "Contents": b.add(Stream({}, C.flatten_layers(p.content(), _layers(d, p), hidden)))}
                out = b.save()
            yield k, out
        except (ValueError, TypeError, KeyError):
            yield k, data

    return kernel(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, content binary", ["doc_id", "content"])


def set_boxes(df: DataFrame, key: str, box: tuple) -> DataFrame:
    def change(b: Builder, d: Document) -> None:
        x, y, w, h = box
        for p in d.pages():
            b.objects[p.num] = {**p.dict, key: [x, y, x + w, y + h]}

    return rewrite(df, change)


def splice(df: DataFrame, before: bytes = b"", after: bytes = b"") -> DataFrame:
    """Content before and after that of every page."""

    def change(b: Builder, d: Document) -> None:
        for p in d.pages():
            own = d.get(p.dict.get("Contents"))
            middle = own if isinstance(own, list) else [p.dict["Contents"]] if own is not None else []
            b.objects[p.num] = {**p.dict, "Contents": [*([b.add(Stream({}, before))] if before else []), *middle, *([b.add(Stream({}, after))] if after else [])]}

    return rewrite(df, change)
