"""The query catalogue: documents are generated from the tables by our own sinks, read again, and analysed; SQL over the source tables says what must come out."""

from __future__ import annotations

import base64
import itertools
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import native as N
from foliospark.functions import udfs as U
from foliospark.kernels import canvas as K
from foliospark.kernels import barcode, filters, fonts, qr
from foliospark.kernels.cmap import ToUnicode, to_unicode_bytes
from foliospark.kernels.objects import Name, Stream
from foliospark.kernels.writer import Builder, Template
from foliospark.operators import build as B
from foliospark.operators import documents as D
from foliospark.operators.rows import kernel, spread
from foliospark.plans import golden
from foliospark.session import kept, shared_folder
from foliospark.sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, for a kernel: every core gets rows."""
    rows = table(spark, sf, name)
    return spread(rows.select(*columns) if columns else rows)


def order_documents(spark, sf, object_streams=False) -> DataFrame:
    """A document per order, kept for all queries that read it."""
    return kept(spark, f"orders {object_streams} {sf}", lambda: _order_documents(spark, sf, object_streams))


def _order_documents(spark, sf, object_streams) -> DataFrame:
    def draw(c: K.Canvas, r: dict) -> None:
        c.begin_text().font("Helvetica", 12).render_mode(3 if r["o_orderstatus"] == "F" else 0).move_text(72, 720)
        c.show(f"ORDER {r['o_orderkey']} {r['o_orderpriority']}").end_text()

    rows = dealt(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return B.generate(rows, "o_orderkey", B.page_of(draw), object_streams)


def line_documents(spark, sf) -> DataFrame:
    """A document per line item, kept for all queries that read it: key l_orderkey, order l_linenumber."""
    return kept(spark, f"lines {sf}", lambda: _line_documents(spark, sf))


@lru_cache(maxsize=64)
def _line_template(flag: str) -> Template:
    """What line items of a flag have in common; left open are two texts and a rectangle."""
    b = Builder()
    layer = K.layer(b, flag)
    c = K.Canvas(b)
    text = lambda y: c.begin_text().font("Helvetica", 12).move_text(72, y).raw(K.MARK).end_text()
    text(700).begin_layer(layer)
    text(650).raw(K.MARK).fill().end_layer()
    return Template(b, b.get(c.page())["Contents"], K.MARK)


def _line_documents(spark, sf, where=None) -> DataFrame:
    def run(order, line, quantity, flag):
        yield order, line, _line_template(flag).fill(K.shown(f"{order}/{line}"), K.shown(f"qty {quantity:g}"), K.operation("re", 10, 10, quantity, 5))

    rows = dealt(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return kernel(rows if where is None else rows.where(where), run, "l_orderkey bigint, l_linenumber int, content binary")


def part_documents(spark, sf) -> DataFrame:
    """A document per part, kept for all queries that read it: boxes, rotation, a placed image, a spot colour and a font, all from its columns."""
    return kept(spark, f"parts {sf}", lambda: _part_documents(spark, sf))


def _part_documents(spark, sf) -> DataFrame:
    def draw(b: Builder, r: dict) -> None:
        k, size = r["p_partkey"], r["p_size"]
        c = K.Canvas(b)
        picture = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": size * 20, "Height": size * 10, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}, b"\xff\xd8"))
        c.image(picture, 72, 72, 72 + k % 200, 36 + k % 100)
        c.fill_separation(K.separation(b, r["p_brand"] if size % 4 else "None", 0, 1, 1, 0), 1).rectangle(0, 0, 10, 10).fill()
        c.text(10, 500, r["p_name"], "Courier" if size % 2 else "Times-Roman")
        more = {"Rotate": size * 90 - 180}
        if size % 2 == 0:
            more["CropBox"] = [10, 10, 500 + size, 600]
        if size % 3 == 0:
            more["TrimBox"] = [400 + size, 500, 20, 20]  # corners the other way round
        c.page((0, 0, 612, 792), **more)

    return B.generate(dealt(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", draw)


# ---- load, text, recovery ----


@query("SELECT o_orderkey AS doc_id, 'ORDER ' || o_orderkey || ' ' || o_orderpriority AS text, 12.0::DOUBLE AS font_size, 720.0::DOUBLE AS y FROM orders")
def doc_roundtrip_text(spark, sf):
    e = D.render_events(order_documents(spark, sf))
    return e.select("doc_id", "text", "font_size", F.col("tm.f").alias("y"))


@query("SELECT o_orderkey AS doc_id, '1.7' AS version, false AS is_encrypted, 1::INTEGER AS page_count, 4::INTEGER AS max_object_number FROM orders")
def document_facts(spark, sf):
    return D.pdf_docs(order_documents(spark, sf)).select("doc_id", "version", "is_encrypted", "page_count", "max_object_number")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 AS used_recovery_scan, o_orderkey % 3 = 0 AS has_reason, 1::INTEGER AS page_count FROM orders")
def recovery_flags(spark, sf):
    """A third of the documents has no cross-reference offset any more."""

    def damage(key, content):
        yield key, content.replace(b"startxref", b"startxxxx") if key % 3 == 0 else content

    docs = kernel(order_documents(spark, sf), damage, "doc_id bigint, content binary")
    return D.pdf_docs(docs).select("doc_id", "used_recovery_scan", F.col("recovery_reason").isNotNull().alias("has_reason"), "page_count")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS parsed FROM orders")
def truncated_documents(spark, sf):
    """Half of the documents are cut after the header: a row each, never a failed task."""
    docs = kernel(order_documents(spark, sf), lambda k, c: [(k, c if k % 2 == 0 else c[:20])], "doc_id bigint, content binary")
    return D.pdf_docs(docs).select("doc_id", F.col("parse_error").isNull().alias("parsed"))


@query("SELECT o_orderkey AS doc_id, 'ORDER ' || o_orderkey || ' ' || o_orderpriority AS text FROM orders")
def object_stream_text(spark, sf):
    return D.render_events(order_documents(spark, sf, object_streams=True)).select("doc_id", "text")


@query("SELECT o_orderkey AS doc_id, 2::BIGINT AS n_sections, 1::BIGINT AS replaced, 'UPDATED ' || o_orderkey AS text FROM orders")
def xref_newest_wins(spark, sf):
    """An incremental update replaces the content stream; the newest entry of each object holds."""

    def update(key, content):
        from foliospark.kernels.document import Document

        d = Document(content)
        num = d.pages()[0].dict["Contents"].num
        body = b"BT /F0 12 Tf (UPDATED %d) Tj ET" % key
        at, before = len(content), content.rindex(b"startxref")
        start = int(content[before + 9 :].split()[0])
        new = b"%d 0 obj\n<</Length %d>>\nstream\n%s\nendstream\nendobj\n" % (num, len(body), body)
        root = d.trailer["Root"].num
        tail = b"xref\n%d 1\n%010d 00000 n \ntrailer\n<</Size %d/Root %d 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (num, at, d.max_object + 1, root, start, at + len(new))
        yield key, content + new + tail

    docs = kernel(order_documents(spark, sf), update, "doc_id bigint, content binary")
    entries = D.xref_entries(docs)
    sections = entries.groupBy("doc_id").agg(F.countDistinct("section_ord").alias("n_sections"))
    replaced = D.newest_entries(entries).where("section_ord = 0").groupBy("doc_id").agg(F.count("*").alias("replaced"))
    text = D.render_events(docs).select("doc_id", "text")
    return sections.join(replaced, "doc_id").join(text, "doc_id")


@query("SELECT o_orderkey AS doc_id, count(*)::BIGINT AS n_tokens, 5::BIGINT AS n_strings FROM orders, range(22) GROUP BY ALL")
def token_counts(spark, sf):
    """Tokens of a generated text: 5 strings, names, numbers and brackets."""
    text = F.concat(F.lit("(a(b)c) (\\051) <41> () (x) /N#20m /B 1 -2.5 +3 .5 4. [ 1 2 ] << /K true >> q Q % note "), F.col("o_orderkey").cast("string"))
    rows = dealt(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.encode(text, "UTF-8").alias("content"))
    return D.tokens(rows).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count(F.when(F.col("kind") == "string", 1)).alias("n_strings"))


# ---- merging ----

PAGES = "SELECT l_orderkey AS doc_id, count(*)::INTEGER AS page_count FROM lineitem GROUP BY 1"


@query(PAGES)
def page_count_merge(spark, sf):
    return D.pdf_docs(B.merge(line_documents(spark, sf), "l_orderkey", "l_linenumber")).select("doc_id", "page_count")


@query(PAGES)
def objstm_equivalence(spark, sf):
    return D.pdf_docs(B.merge(line_documents(spark, sf), "l_orderkey", "l_linenumber", object_streams=True)).select("doc_id", "page_count")


@query("SELECT l_orderkey AS doc_id, ceil(count(*) / 4.0)::BIGINT AS sheets, 2 * count(*)::BIGINT AS texts FROM lineitem GROUP BY 1")
def form_nup(spark, sf):
    """Four pages to a sheet, each a form: texts are found within the forms."""
    docs = B.impose(B.merge(line_documents(spark, sf), "l_orderkey", "l_linenumber"), 2, 2)
    e = D.render_events(docs, ["page_no", "depth", "kind"]).where("kind = 'text' and depth = 1")
    return e.groupBy("doc_id").agg(F.countDistinct("page_no").alias("sheets"), F.count("*").alias("texts"))


@query("SELECT l_orderkey AS doc_id, (3 + 2 * count(*))::BIGINT AS reached, (3 + 2 * count(*))::BIGINT AS objects FROM lineitem GROUP BY 1")
def reachable_objects(spark, sf):
    """A page per line item, no layers: catalog, tree, and a page and its own content each; the fonts are direct. One dead object is dropped by the sink."""

    def draw(b: Builder, r: dict) -> None:
        b.add({"Dead": True})
        for line in r["rows"]:
            c = K.Canvas(b)
            c.text(72, 700, f"{line['l_linenumber']}")
            c.page()
        b.info(Creator="foliospark")

    rows = B.grouped(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_quantity"])
    docs = kept(spark, f"order lines {sf}", lambda: B.generate(rows, "l_orderkey", draw))  # read twice, made once
    reached = D.reachable(D.cos_edges(docs)).groupBy("doc_id").agg(F.count("*").alias("reached"))
    objects = D.cos_objects(docs).groupBy("doc_id").agg(F.count("*").alias("objects"))
    return reached.join(objects, "doc_id")


# ---- pages ----


@query(
    """SELECT p_partkey AS doc_id, 612.0::DOUBLE AS media_w,
       CASE WHEN p_size % 2 = 0 THEN 490.0 + p_size ELSE 612.0 END::DOUBLE AS crop_w,
       CASE WHEN p_size % 3 = 0 THEN 380.0 + p_size WHEN p_size % 2 = 0 THEN 490.0 + p_size ELSE 612.0 END::DOUBLE AS trim_w,
       CASE WHEN p_size % 2 = 0 THEN 590.0 ELSE 792.0 END::DOUBLE AS bleed_h, p_size % 3 = 0 AS has_trim FROM part"""
)
def box_fallback(spark, sf):
    p = D.resolved_boxes(D.pdf_pages(part_documents(spark, sf)))
    return p.select("doc_id", F.col("media_box.w").alias("media_w"), F.col("crop_box.w").alias("crop_w"), F.col("trim_box.w").alias("trim_w"), F.col("bleed_box.h").alias("bleed_h"), "has_trim")


@query("SELECT p_partkey AS doc_id, ((((p_size * 90 - 180) % 360) + 360) % 360)::INTEGER AS rotation, ((((p_size * 90 - 180) % 360) + 360) % 360)::INTEGER AS native_rotation FROM part")
def rotation_norm(spark, sf):
    pages = D.pdf_pages(part_documents(spark, sf)).select("doc_id", "rotation")
    return pages.join(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), N.rotation(F.col("p_size") * 90 - 180).alias("native_rotation")), "doc_id")


@query(
    """SELECT n_regionkey::BIGINT AS doc_id, count(*)::BIGINT AS pages, sum(300 + n_nationkey)::DOUBLE AS sum_w, sum(CASE WHEN n_regionkey % 2 = 1 THEN 90 ELSE 0 END)::BIGINT AS sum_rotation
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def page_tree_inherit(spark, sf):
    """A tree of region, nation and customer: the media box comes from the nation, the rotation from the region."""

    def draw(b: Builder, r: dict) -> None:
        root = b.get(b.tree)
        by: dict = {}
        for c in r["rows"]:
            by.setdefault(c["n_nationkey"], []).append(c["c_custkey"])
        kids = []
        for nation, customers in by.items():
            ref = b.add(None)
            b.put(ref, {"Type": Name("Pages"), "Parent": b.tree, "MediaBox": [0, 0, 300 + nation, 400], "Count": len(customers), "Kids": [b.add({"Type": Name("Page"), "Parent": ref}) for _ in customers]})
            kids.append(ref)
        b.put(b.tree, root | {"Kids": kids, "Count": len(r["rows"])} | ({"Rotate": 90} if r["n_regionkey"] % 2 else {}))

    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("bigint"), "n_nationkey", "c_custkey")
    docs = B.generate(B.grouped(joined, "n_regionkey", ["n_nationkey"], ["c_custkey"]), "n_regionkey", draw)
    p = D.pdf_pages(docs)
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("media_box.w").alias("sum_w"), F.sum("rotation").alias("sum_rotation"))


@query("SELECT s_suppkey AS doc_id, 'Text' AS subtype, s_name AS contents, 'n' || s_nationkey AS title FROM supplier")
def page_annotations(spark, sf):
    def draw(b: Builder, r: dict) -> None:
        c = K.Canvas(b)
        c.annotations.append(K.text_annotation((10, 10, 20, 20), r["s_name"], f"n{r['s_nationkey']}"))
        c.page()

    return D.annotations(B.generate(dealt(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey"), "s_suppkey", draw)).select("doc_id", "subtype", "contents", "title")


@query("SELECT o_orderkey AS doc_id, 3::BIGINT AS texts, 'before' AS first, 'after' AS last FROM orders")
def content_splice(spark, sf):
    docs = B.splice(order_documents(spark, sf), b"q BT (before) Tj ET Q", b"BT (after) Tj ET")
    e = D.render_events(docs)
    return e.groupBy("doc_id").agg(F.count("*").alias("texts"), F.min_by("text", "seq").alias("first"), F.max_by("text", "seq").alias("last"))


@query("SELECT p_partkey AS doc_id, 100.0::DOUBLE AS trim_w, 50.0::DOUBLE AS trim_h FROM part")
def set_trim_box(spark, sf):
    p = D.pdf_pages(B.set_boxes(part_documents(spark, sf), "TrimBox", (10, 10, 100, 50)))
    return p.select("doc_id", F.col("trim_box.w").alias("trim_w"), F.col("trim_box.h").alias("trim_h"))


@query("SELECT o_orderkey AS doc_id, 'order ' || o_orderkey AS creator, 'foliospark' AS producer FROM orders")
def document_information(spark, sf):
    def draw(b: Builder, r: dict) -> None:
        b.add_page()
        b.info(Creator=f"order {r['o_orderkey']}", Producer="foliospark")

    return D.pdf_docs(B.generate(dealt(spark, sf, "orders", "o_orderkey"), "o_orderkey", draw)).select("doc_id", "creator", "producer")


# ---- events and preflight ----

DPI = "SELECT p_partkey AS doc_id, round(p_size * 20 / ((72 + p_partkey % 200) / 72.0), 4)::DOUBLE AS dpi_x, round(p_size * 10 / ((36 + p_partkey % 100) / 72.0), 4)::DOUBLE AS dpi_y FROM part"


@query(f"SELECT * FROM ({DPI}) WHERE dpi_x < 300 OR dpi_y < 300")
def image_dpi_preflight(spark, sf):
    e = D.low_resolution(D.render_events(part_documents(spark, sf)))
    return e.select("doc_id", F.round("dpi_x", 4).alias("dpi_x"), F.round("dpi_y", 4).alias("dpi_y"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'")
def invisible_text(spark, sf):
    return D.invisible_text(D.render_events(order_documents(spark, sf))).select("doc_id")


@query(
    """SELECT op, (CASE WHEN op IN ('BDC', 'EMC', 're', 'f') THEN 1 ELSE 2 END * n)::BIGINT AS n
       FROM (SELECT count(*) AS n FROM lineitem), (VALUES ('BT'), ('ET'), ('Tf'), ('Td'), ('Tj'), ('BDC'), ('EMC'), ('re'), ('f')) AS v(op)"""
)
def op_histogram(spark, sf):
    docs = line_documents(spark, sf).select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("doc_id"), "content")
    return D.content_ops(docs, ["op"]).groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc_id, sum(l_quantity)::DOUBLE AS e, sum(l_linenumber)::DOUBLE AS f FROM lineitem GROUP BY 1")
def ctm_fold(spark, sf):
    """A translation per line item: the last event stands where their sum is."""

    def draw(b: Builder, r: dict) -> None:
        c = K.Canvas(b)
        for line in r["rows"]:
            c.concat(1, 0, 0, 1, line["l_quantity"], line["l_linenumber"])
        c.rectangle(0, 0, 1, 1).fill()
        c.page()

    rows = B.grouped(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_quantity"])
    return D.render_events(B.generate(rows, "l_orderkey", draw)).select("doc_id", F.col("ctm.e").alias("e"), F.col("ctm.f").alias("f"))


@query("SELECT l_returnflag AS flag, count(*)::BIGINT AS filled, sum(l_quantity)::DOUBLE AS width FROM lineitem GROUP BY 1")
def path_paint_counts(spark, sf):
    docs = line_documents(spark, sf).select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("doc_id"), "content")
    e = D.render_events(docs, ["kind", "paint_op", "subpaths", "tags"]).where("kind = 'path' and paint_op = 2")
    points = F.col("subpaths")[0]["pts"]
    return e.groupBy(F.col("tags")[0]["props"].alias("flag")).agg(F.count("*").alias("filled"), F.sum(points[1]["x"] - points[0]["x"]).alias("width"))


@query("SELECT l_returnflag AS layer, count(*)::BIGINT AS texts FROM lineitem GROUP BY 1")
def marked_content_text(spark, sf):
    docs = line_documents(spark, sf).select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("doc_id"), "content")
    e = D.render_events(docs, ["kind", "tags"]).where("kind = 'text' and size(tags) > 0")
    return e.groupBy(F.col("tags")[0]["props"].alias("layer")).agg(F.count("*").alias("texts"))


@query("SELECT l_orderkey || '/' || l_linenumber AS doc_id, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END)::BIGINT AS texts, 0::BIGINT AS marked FROM lineitem GROUP BY 1")
def flatten_layers(spark, sf):
    docs = line_documents(spark, sf).select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("doc_id"), "content")
    e = D.render_events(B.flatten_layers(docs, lambda layer: layer == "R"), ["kind", "tags"])
    return e.groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "text", 1)).alias("texts"), F.count(F.when(F.size("tags") > 0, 1)).alias("marked"))


@query("SELECT p_brand AS spot, count(*)::BIGINT AS documents FROM part WHERE p_size % 4 <> 0 GROUP BY 1")
def spot_colors(spark, sf):
    return D.spot_colors(part_documents(spark, sf)).groupBy("spot").agg(F.count("*").alias("documents"))


@query("SELECT p_partkey AS doc_id, 'Separation(' || CASE WHEN p_size % 4 <> 0 THEN p_brand ELSE 'None' END || ')' AS description FROM part")
def color_space_descriptions(spark, sf):
    return D.color_spaces(part_documents(spark, sf)).select("doc_id", "description")


@query("SELECT CASE WHEN p_size % 2 = 1 THEN 'Courier' ELSE 'Times-Roman' END AS font, false AS is_embedded, count(*)::BIGINT AS n FROM part GROUP BY 1")
def fonts_embedded(spark, sf):
    return D.fonts(part_documents(spark, sf)).groupBy("font", "is_embedded").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, ['DCTDecode'] AS filters, true AS unsupported FROM part")
def image_filters(spark, sf):
    o = D.cos_objects(part_documents(spark, sf)).where("kind = 'stream' and size(filters) > 0 and array_contains(filters, 'DCTDecode')")
    return o.select("doc_id", "filters", N.unsupported_filter(F.col("filters")).alias("unsupported"))


@query("SELECT p_partkey AS doc_id, p_size * 20 AS width, p_size * 10 AS height FROM part")
def object_values(spark, sf):
    """Typed reads of a dictionary's values through VARIANT."""
    o = D.cos_objects(part_documents(spark, sf)).where("kind = 'stream' and array_contains(filters, 'DCTDecode')")
    v = F.parse_json("value_json")
    return o.select("doc_id", F.variant_get(v, "$.Width", "int").alias("width"), F.variant_get(v, "$.Height", "int").alias("height"))


@query("SELECT o_orderkey AS doc_id, 1::BIGINT AS pages FROM orders")
def resolved_references(spark, sf):
    docs = order_documents(spark, sf)
    r = D.resolve(D.cos_edges(docs).where("path like '%/Kids%'"), D.cos_objects(docs)).where("dst_kind = 'dict'")
    return r.groupBy("doc_id").agg(F.count("*").alias("pages"))


# ---- dedup and codecs ----


@query("SELECT count(DISTINCT p_size)::BIGINT AS pictures, count(*)::BIGINT AS documents FROM part")
def dedup_streams(spark, sf):
    """Images of all documents by the hash of their structure: those of one size are one."""
    docs = part_documents(spark, sf)
    images = D.image_payloads(docs).select("doc_id", "obj_num")
    h = D.structural_hashes(docs).join(images, ["doc_id", "obj_num"])
    first = h.groupBy("hash").agg(F.count("*").alias("n"))
    return first.agg(F.count("*").alias("pictures"), F.sum("n").alias("documents"))


@query("SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber || ' ' || l_quantity)::BIGINT AS contents FROM lineitem GROUP BY 1")
def merged_contents(spark, sf):
    docs = B.merge(line_documents(spark, sf), "l_orderkey", "l_linenumber")
    o = D.cos_objects(docs, ["kind", "raw"]).where("kind = 'stream'")
    return o.groupBy("doc_id").agg(F.countDistinct(N.content_hash(F.col("raw"))).alias("contents"))


CODEC = "SELECT doc_id, octet_length(encode(text))::INTEGER AS n_bytes, sha256(text) AS digest FROM documents"


def _codec(spark, sf, encode, names):
    rows = dealt(spark, sf, "documents", "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    packed = kernel(rows, lambda k, raw: [(k, encode(raw))], "doc_id bigint, raw binary")
    out = packed.select("doc_id", U.decode(F.col("raw"), names).alias("data"))
    return out.select("doc_id", F.octet_length("data").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query(CODEC)
def hex_codec(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.hex(F.encode("text", "UTF-8")), F.lit(">")).alias("x"))
    data = N.ascii_hex_decode(F.col("x"))
    return rows.select("doc_id", F.octet_length(data).alias("n_bytes"), F.sha2(data, 256).alias("digest"))


@query(CODEC)
def a85_codec(spark, sf):
    return _codec(spark, sf, lambda raw: base64.a85encode(raw) + b"~>", ["ASCII85Decode"])


@query(CODEC)
def rle_codec(spark, sf):
    """Runs of equal bytes as repeats, the rest as literals of one byte."""

    def encode(raw):
        out = bytearray()
        for value, run in itertools.groupby(raw):
            n = len(list(run))
            for at in range(0, n, 128):
                m = min(128, n - at)
                out += bytes([257 - m, value]) if m > 1 else bytes([0, value])
        return bytes(out) + b"\x80"

    return _codec(spark, sf, encode, ["RunLengthDecode"])


@query(CODEC)
def flate_codec(spark, sf):
    return _codec(spark, sf, filters.flate_encode, ["FlateDecode"])


@query(CODEC)
def filter_chain(spark, sf):
    return _codec(spark, sf, lambda raw: base64.a85encode(filters.flate_encode(raw)), ["ASCII85Decode", "FlateDecode"])


@query(CODEC)
def string_escape(spark, sf):
    rows = dealt(spark, sf, "documents", "doc_id", "text").select("doc_id", U.read_string(U.literal_string(F.encode("text", "UTF-8"))).alias("data"))
    return rows.select("doc_id", F.octet_length("data").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query("SELECT p_partkey AS doc_id, p_name AS text FROM part")
def to_unicode_decode(spark, sf):
    """Codes of a composite font back to text through the map that the sink wrote."""
    codes = {k: chr(k) for k in range(32, 127)}
    data = to_unicode_bytes(codes)

    def run(key, name):
        yield key, ToUnicode.parse(data).decode(b"".join(ord(c).to_bytes(2) for c in name))

    return kernel(dealt(spark, sf, "part", "p_partkey", "p_name"), run, "doc_id bigint, text string")


# ---- geometry, text, layout ----


@query("SELECT p_partkey AS id, (2 * p_size)::DOUBLE AS a, (3 * p_retailprice)::DOUBLE AS d, round(2 * 7 + p_size, 6)::DOUBLE AS x, round(3 * 11 + p_retailprice, 6)::DOUBLE AS y, (p_retailprice % 40) BETWEEN least(p_size, 20) AND greatest(p_size, 20) AS inside FROM part")
def matrix_algebra(spark, sf):
    m = N.multiply(N.scale(F.col("p_size"), F.col("p_retailprice")), N.scale(2, 3))
    at = N.transform_point(N.multiply(N.scale(2, 3), N.translate(F.col("p_size"), F.col("p_retailprice"))), F.lit(7.0), F.lit(11.0))
    box = N.rectangle(F.col("p_size"), F.lit(0), F.lit(20), F.lit(10))
    inside = N.contains(box, F.col("p_retailprice") % 40, F.lit(5))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), m["a"].alias("a"), m["d"].alias("d"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), inside.alias("inside"))


@query("SELECT p_partkey AS id, round(list_sum([3 * (1 - k / 12.0) * (1 - k / 12.0) * (k / 12.0) * p_size + 3 * (1 - k / 12.0) * (k / 12.0) * (k / 12.0) * 50 + (k / 12.0) * (k / 12.0) * (k / 12.0) * 100 for k in range(1, 13)]), 4)::DOUBLE AS total, 12::INTEGER AS n FROM part")
def bezier_points(spark, sf):
    p = N.curve(F.lit(0.0), F.col("p_size").cast("double"), F.lit(50.0), F.lit(100.0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size(p).alias("n"))


ACCENTED = "Àé—…ß€ Ωx"


@query("SELECT p_partkey AS id, (667 + 556 + 1000 + 1000 + 611 + 556 + 278 + 0 + 500) * p_size / 1000.0::DOUBLE AS helvetica, (722 + 444 + 1000 + 1000 + 500 + 500 + 250 + 0 + 500) * 12.0 / 1000::DOUBLE AS times, 278 * 12.0 / 1000::DOUBLE AS zapf FROM part")
def text_width_accented(spark, sf):
    """Letters, signs and what WinAnsi lacks, in three fonts."""
    text = F.lit(ACCENTED)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (N.text_width(text, "Helvetica", 1.0) * F.col("p_size")).alias("helvetica"), N.text_width(text, "Times-Roman").alias("times"), N.text_width(text, "ZapfDingbats").alias("zapf"))


WIDTHS = "[" + ", ".join(map(str, fonts.widths("Helvetica")[32:127])) + "]"


@query(f"SELECT p_partkey AS id, round(list_sum([{WIDTHS}[ascii(c) - 31] for c in string_split(p_name, '')]) * 12.0 / 1000, 6)::DOUBLE AS width FROM part")
def text_width(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(N.text_width(F.col("p_name")), 6).alias("width"))


@query(
    """WITH RECURSIVE words AS (
         SELECT p_partkey AS id, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS w FROM part
       ), steps AS (
         SELECT id, w, 1 AS k, '' AS line, 0 AS lines FROM words
         UNION ALL
         SELECT id, w, k + 1, CASE WHEN line = '' THEN w[k] WHEN length(line) + 1 + length(w[k]) <= 16 THEN line || ' ' || w[k] ELSE w[k] END,
                lines + CASE WHEN line <> '' AND length(line) + 1 + length(w[k]) > 16 THEN 1 ELSE 0 END
         FROM steps WHERE k <= len(w)
       ) SELECT id, (lines + 1)::INTEGER AS n_lines, line AS last FROM steps WHERE k = len(w) + 1"""
)
def wrap_courier(spark, sf):
    """Lines of 16 letters: words go to the next line where they don't fit."""
    rows = dealt(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand")
    lines = U.wrapped_lines(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 96.0, "Courier", 10)
    return rows.select(F.col("p_partkey").alias("id"), lines.alias("x")).select("id", F.size("x").alias("n_lines"), F.element_at("x", -1).alias("last"))


@query("SELECT p_partkey AS id, round(540.0 * p_size / (p_size + 30.0), 6)::DOUBLE AS first, round(540.0 * 10 / (p_size + 30.0), 6)::DOUBLE AS second FROM part")
def column_widths(spark, sf):
    w = N.column_widths(F.array(F.col("p_size").cast("double"), F.lit(10.0), F.lit(20.0)), F.lit(540.0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(w[0], 6).alias("first"), F.round(w[1], 6).alias("second"))


@query("SELECT c_nationkey::INTEGER AS doc_id, CASE WHEN count(*) <= 34 THEN 1 ELSE 1 + ceil((count(*) - 34) / 34.0) END::INTEGER AS pages, (count(*) + CASE WHEN count(*) <= 34 THEN 1 ELSE 1 + ceil((count(*) - 34) / 34.0) END)::BIGINT AS texts FROM customer GROUP BY 1")
def table_pagination(spark, sf):
    """A row per customer under a repeated header; every row is as high, so the pages follow by arithmetic."""

    def draw(b: Builder, r: dict) -> None:
        t = K.Table([1.0, 2.0], [], header_rows=1)
        for text in ["head", *(f"c{x['c_custkey']}" for x in r["rows"])]:
            t.cells += [K.Cell([K.Paragraph(text)], padding=2.0, colspan=2)]
        f = K.Flow(b, page=(612.0, 792.0), margin=36)
        f.add(t)
        f.close()

    rows = B.grouped(table(spark, sf, "customer"), "c_nationkey", ["c_custkey"], ["c_acctbal"])
    e = D.render_events(B.generate(rows, "c_nationkey", draw)).where("kind = 'text'")
    return e.groupBy("doc_id").agg(F.max("page_no").alias("pages"), F.count("*").alias("texts"))


# ---- barcodes ----

EAN_SQL = "[" + ", ".join(f"'{x}'" for x in barcode.EAN_L) + "]"
PARITY_SQL = "[" + ", ".join(f"'{x}'" for x in barcode.EAN_PARITY) + "]"
CODE39_SQL = "[" + ", ".join(f"'{x}'" for x in barcode.CODE39.values()) + "]"
CODE128_SQL = "[" + ", ".join(f"'{x}'" for x in barcode.CODE128) + "]"
ITF_SQL = "[" + ", ".join(f"'{x}'" for x in barcode.ITF) + "]"


def ean_sql(digits: str, more: str = "") -> str:
    """Bars of 12 digits, by the tables of the odd codes and of the sides."""
    return f"""WITH d AS (SELECT p_partkey AS id, {digits} AS d FROM part), c AS (
        SELECT id, d, (10 - list_sum([substr(d, k, 1)::INTEGER * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END for k in range(1, 13)]) % 10) % 10 AS c FROM d), w AS (
        SELECT id, c, d || c AS w, {PARITY_SQL}[substr(d, 1, 1)::INTEGER + 1] AS p FROM c)
        SELECT id, c::INTEGER AS check_digit, '101' || array_to_string([CASE WHEN substr(p, k - 1, 1) = 'L' THEN {EAN_SQL}[substr(w, k, 1)::INTEGER + 1] ELSE reverse(translate({EAN_SQL}[substr(w, k, 1)::INTEGER + 1], '01', '10')) END for k in range(2, 8)], '')
        || '01010' || array_to_string([translate({EAN_SQL}[substr(w, k, 1)::INTEGER + 1], '01', '10') for k in range(8, 14)], '') || '101' AS modules{more} FROM w"""


@query(ean_sql("(p_partkey % 10) || lpad(p_partkey::VARCHAR, 11, '0')", ", true AS same"))
def ean13(spark, sf):
    """Every first digit, so every pattern of sides."""
    digits = F.concat((F.col("p_partkey") % 10).cast("string"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))
    m = N.ean13(digits)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.ean_check(digits).alias("check_digit"), m.alias("modules"), (m == U.barcode_modules(digits, "ean13")).alias("same"))


@query(ean_sql("'0' || lpad(p_partkey::VARCHAR, 11, '0')"))
def upca(spark, sf):
    digits = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.ean_check(F.concat(F.lit("0"), digits)).alias("check_digit"), U.barcode_modules(digits, "upca").alias("modules"))


@query(
    f"""WITH t AS (SELECT p_partkey AS id, upper(replace(p_brand, '#', '-')) AS t FROM part), n AS (
        SELECT id, [instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. $/+%*', c) for c in string_split('*' || t || '*', '')] AS n, t FROM t)
        SELECT id, array_to_string([array_to_string([repeat(CASE WHEN k % 2 = 1 THEN '1' ELSE '0' END, CASE WHEN substr({CODE39_SQL}[x], k, 1) = 'w' THEN 3 ELSE 1 END) for k in range(1, 10)], '') for x in n], '0') AS modules, true AS same,
        list_sum([instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. $/+%*', c) - 1 for c in string_split(t, '')])::INTEGER % 43 AS check_value FROM n"""
)
def code39(spark, sf):
    text = F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))
    m = N.code39(text)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), m.alias("modules"), (m == U.barcode_modules(text, "code39")).alias("same"), N.code39_check(text).alias("check_value"))


@query(
    f"""WITH d AS (SELECT p_partkey AS id, CASE WHEN length(p_partkey::VARCHAR) % 2 = 1 THEN '0' ELSE '' END || p_partkey AS d FROM part)
        SELECT id, '1010' || array_to_string([array_to_string([repeat('1', CASE WHEN substr({ITF_SQL}[substr(d, 2 * j - 1, 1)::INTEGER + 1], k, 1) = 'w' THEN 3 ELSE 1 END) || repeat('0', CASE WHEN substr({ITF_SQL}[substr(d, 2 * j, 1)::INTEGER + 1], k, 1) = 'w' THEN 3 ELSE 1 END) for k in range(1, 6)], '') for j in range(1, length(d) // 2 + 1)], '') || '11101' AS modules, true AS same FROM d"""
)
def itf(spark, sf):
    digits = F.col("p_partkey").cast("string")
    m = N.itf(digits)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), m.alias("modules"), (m == U.barcode_modules(digits, "itf")).alias("same"))


@query(
    f"""WITH d AS (SELECT p_partkey AS id, lpad(p_partkey::VARCHAR, 12, '0') AS d FROM part), v AS (
        SELECT id, [substr(d, 2 * k - 1, 2)::INTEGER for k in range(1, 7)] AS v FROM d), c AS (
        SELECT id, v, ((105 + list_sum([k * v[k] for k in range(1, 7)])) % 103)::INTEGER AS c FROM v)
        SELECT id, c AS check_value, array_to_string([array_to_string([repeat(CASE WHEN k % 2 = 1 THEN '1' ELSE '0' END, substr({CODE128_SQL}[x + 1], k, 1)::INTEGER) for k in range(1, length({CODE128_SQL}[x + 1]) + 1)], '') for x in [105] || v || [c, 106]], '') AS modules FROM c"""
)
def code128_digits(spark, sf):
    digits = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.code128_check(digits).alias("check_value"), U.barcode_modules(digits, "code128").alias("modules"))


QR_CASE = " ".join(f"WHEN need <= {qr.data_codewords(v, 'M')} THEN {v}" for v in range(1, 41))


@query(f"SELECT id, CASE {QR_CASE} END::INTEGER AS version FROM (SELECT p_partkey AS id, length(p_name) + 3 AS need FROM part WHERE NOT regexp_matches(p_name, '^[0-9A-Z $%*+./:-]+$') UNION ALL SELECT p_partkey, ceil((length(p_name) // 2 * 11 + length(p_name) % 2 * 6) / 8.0) + 3 FROM part WHERE regexp_matches(p_name, '^[0-9A-Z $%*+./:-]+$'))")
def qr_version(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.qr_version(F.col("p_name")).alias("version"))


@query("SELECT p_partkey AS id, p_name AS text FROM part UNION ALL SELECT -p_partkey, upper(p_name) FROM part UNION ALL SELECT p_partkey + 1000000000, p_partkey::VARCHAR || repeat('7', p_size::INTEGER * 8) FROM part")
def qr_matrix(spark, sf):
    """Symbols of bytes, of letters and of digits, of several versions and all levels, read again by the specification's procedure."""
    p = dealt(spark, sf, "part", "p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    rows = p.select(key.alias("id"), F.col("p_name").alias("text"))
    rows = rows.unionByName(p.select((-key).alias("id"), F.upper("p_name").alias("text")))
    rows = rows.unionByName(p.select((key + 1000000000).alias("id"), F.concat(key.cast("string"), F.expr("repeat('7', p_size * 8)")).alias("text")))
    blocks = lambda v, level: (qr._blocks[level][v - 1], qr._ec[level][v - 1])
    return kernel(rows, lambda k, text: [(k, golden.read_qr(qr.rows(text, "LMQH"[k % 4]), blocks))], "id bigint, text string")


@query(f"SELECT id, (17 + 4 * version + 8)::DOUBLE AS box, 0::BIGINT AS light FROM (SELECT id, CASE {QR_CASE} END AS version FROM (SELECT p_partkey AS id, ceil((ceil(length(p_partkey::VARCHAR) * 10 / 3.0)) / 8.0) + 3 AS need FROM part))")
def qr_form(spark, sf):
    """A QR form placed on a page: its box has the quiet zone, and its rectangles cover the dark modules."""

    def draw(b: Builder, r: dict) -> None:
        c = K.Canvas(b)
        c.form(K.qr_form(b, str(r["p_partkey"])), 2, 0, 0, 2, 50, 50)
        c.page()

    docs = B.generate(dealt(spark, sf, "part", "p_partkey"), "p_partkey", draw)
    box = D.cos_objects(docs).where("kind = 'stream' and value_json like '%BBox%'").select("doc_id", F.variant_get(F.parse_json("value_json"), "$.BBox[2]", "double").alias("box"))
    area = F.aggregate("subpaths", F.lit(0.0), lambda s, p: s + (p["pts"][1]["x"] - p["pts"][0]["x"]) * (p["pts"][2]["y"] - p["pts"][1]["y"]))
    drawn = D.render_events(docs).where("kind = 'path' and depth = 1").select("doc_id", area.alias("area"))
    dark = kernel(dealt(spark, sf, "part", "p_partkey"), lambda k: [(k, float(sum(r.count("1") for r in qr.rows(str(k)))))], "doc_id bigint, dark double")
    return box.join(drawn, "doc_id").join(dark, "doc_id").select(F.col("doc_id").alias("id"), "box", (F.col("area") - F.col("dark")).cast("bigint").alias("light"))


@query("SELECT p_partkey AS id, 'jpg' AS extension, 'FFD8' AS payload, p_size * 20 AS width FROM part")
def image_payload(spark, sf):
    return D.image_payloads(part_documents(spark, sf)).select(F.col("doc_id").alias("id"), "extension", F.hex("payload").alias("payload"), "width")


@query(
    """SELECT p_partkey AS id, [1, p_size, 3][p_size % 5 + 1] AS item, [1, p_size, 3, 9] AS appended, [1, p_size] || [9] || [3] AS inserted, [1, 9, 3] AS replaced,
       CASE WHEN p_size = 3 THEN [1, 3] ELSE [1, p_size] END AS removed FROM part"""
)
def array_edits(spark, sf):
    """Items of an array by place, null out of range, and arrays with items added, set and taken out."""
    size = F.col("p_size")
    a = F.array(F.lit(1), size, F.lit(3))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), N.item(a, size % 5).alias("item"), N.appended(a, F.lit(9)).alias("appended"), N.inserted(a, F.lit(2), F.lit(9)).alias("inserted"),
        N.replaced(a, F.lit(1), F.lit(9)).alias("replaced"), N.without_first(a, F.lit(3)).alias("removed"),
    )


@query("SELECT p_partkey AS id, sqrt(p_size * p_size + 16.0)::DOUBLE AS sx, 3.0::DOUBLE AS sy, p_size / 72.0::DOUBLE AS inches, p_size * 72.0::DOUBLE AS points, least(p_size, 25)::DOUBLE AS x, abs(25 - p_size)::DOUBLE AS w FROM part")
def geometry_measures(spark, sf):
    size = F.col("p_size")
    m, r = N.matrix(size, 4, 0, 3, 1, 2), N.rectangle(size.cast("double"), F.lit(1.0), F.lit(25.0), F.lit(0.0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.scale_x(m).alias("sx"), N.scale_y(m).alias("sy"), N.inches(size).alias("inches"), N.points(size).cast("double").alias("points"), r["x"].alias("x"), r["w"].alias("w"))


@query("SELECT s_suppkey AS id, 1::INTEGER AS pages, 200.0::DOUBLE AS width, s_name AS text FROM supplier")
def files_roundtrip(spark, sf):
    """Documents written as files; pages come through the data source, texts through the scan of binary files."""

    def draw(b: Builder, r: dict) -> None:
        K.Canvas(b).text(10, 10, r["s_name"]).page((0, 0, 200, 100))

    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    pdf.register(spark)
    pdf.write_files(B.generate(dealt(spark, sf, "supplier", "s_suppkey", "s_name"), "s_suppkey", draw), folder)
    number = F.regexp_extract("doc_id", r"([0-9]+)\.pdf$", 1).cast("bigint").alias("id")
    pages = spark.read.format("pdf").load(folder).groupBy(number).agg(F.max("page_no").alias("pages"), F.max("width").alias("width"))
    return pages.join(D.render_events(pdf.read_files(spark, folder)).select(number, "text"), "id")


def _golden(area: str) -> None:
    def read(spark, sf):
        return golden.read(spark, area)

    read.__name__ = f"golden_{area}"
    query(golden.expected(area))(read)


for _area in golden.AREAS:
    _golden(_area)


@query("SELECT p_partkey AS id, p_size * 7 AS width, p_size * 3 AS height, 3::INTEGER AS components FROM part")
def jpeg_headers(spark, sf):
    """Headers put together from the sizes: start, an application segment, and a frame."""
    two = lambda c: F.substring(F.unhex(F.lpad(F.hex(c), 4, "0")), 1, 2)
    data = F.concat(F.unhex(F.lit("FFD8FFE000044A46FFC0001108")), two(F.col("p_size") * 3), two(F.col("p_size") * 7), F.unhex(F.lit("03012200021101031101")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), U.jpeg_header(data).alias("j")).select("id", "j.width", "j.height", "j.components")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
