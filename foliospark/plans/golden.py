"""Cases written by hand from the format's public specification, not by our sinks: bytes, and what must be read from them.

Each area is a table (name, data) that a kernel reads in tasks like any other documents; SQL holds what is expected.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from foliospark.kernels import canvas, filters, fonts, images, inspect, writer
from foliospark.kernels.content import Interpreter
from foliospark.kernels.document import Document
from foliospark.kernels.objects import Name, PdfString, Ref
from foliospark.kernels.syntax import Reader
from foliospark.operators.rows import kernel, spread

Case = tuple[str, bytes, str]


def assembled(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R", head: bytes = b"%PDF-1.4\n", wrong: dict[int, int] | None = None) -> bytes:
    """A file with a classic cross-reference table; wrong: what is added to an offset."""
    out, offsets = head, {}
    for n, body in objects.items():
        offsets[n] = len(out) + (wrong or {}).get(n, 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at, size = len(out), max(objects) + 1
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, offsets[n]) for n in objects)
    return out + b"trailer\n<</Size %d %s>>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, at)


def updated(data: bytes, objects: dict[int, bytes], trailer: bytes) -> bytes:
    """An incremental update."""
    before = data[data.rindex(b"startxref") + 10 :].split()[0]
    out, rows = data, b""
    for n, body in objects.items():
        rows += b"%d 1\n%010d 00000 n \n" % (n, len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + b"xref\n%strailer\n<</Size 20 /Prev %s %s>>\nstartxref\n%d\n%%%%EOF\n" % (rows, before, trailer, len(out))


def stream(data: bytes, more: bytes = b"", length: bytes | None = None) -> bytes:
    return b"<</Length %s%s>>\nstream\n%s\nendstream" % (b"%d" % len(data) if length is None else length, more, data)


HI = stream(b"BT /F 10 Tf (hi) Tj ET")
BASIC = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 200 100]/Contents 4 0 R>>", 4: HI}


def object_stream(members: dict[int, bytes]) -> bytes:
    head, body = b"", b""
    for n, x in members.items():
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    return stream(head + body, b"/Type/ObjStm/N %d/First %d" % (len(members), len(head)))


def with_xref_stream(objects: dict[int, bytes], packed: dict[int, bytes], in_stream: int, trailer: bytes, widths: tuple[int, int, int], number: int = 15) -> bytes:
    """A file whose cross-references are a stream of the given field widths."""
    objects = objects | {in_stream: object_stream(packed)}
    out, rows = b"%PDF-1.5\n", {0: (0, 0, 0)}
    for n, body in objects.items():
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    rows |= {n: (2, in_stream, k) for k, n in enumerate(packed)}
    at = len(out)
    index = b" ".join(b"%d 1" % n for n in sorted(rows))
    data = b"".join(b"".join(v.to_bytes(w) for v, w in zip(rows[n], widths)) for n in sorted(rows))
    out += b"%d 0 obj\n%s\nendobj\n" % (number, stream(data, b"/Type/XRef/Size 16/W[%d %d %d]/Index[%s]%s" % (*widths, index, trailer)))
    return out + b"startxref\n%d\n%%%%EOF\n" % at


def hybrid() -> bytes:
    """A table, and beside it a stream that says where an object that old readers don't see is."""
    out = b"%PDF-1.5\n"
    offsets = {}
    for n, body in (BASIC | {7: object_stream({6: b"<</Title(seen)>>"})}).items():
        offsets[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    place = len(out)
    out += b"8 0 obj\n%s\nendobj\n" % stream(struct.pack(">BHB", 2, 7, 0), b"/Type/XRef/Size 9/W[1 2 1]/Index[6 1]")
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in offsets.items())
    return out + b"trailer\n<</Size 9/Root 1 0 R/Info 6 0 R/XRefStm %d>>\nstartxref\n%d\n%%%%EOF\n" % (place, at)


DOCUMENTS: list[Case] = [
    ("plain", assembled(BASIC), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("catalog_version", assembled(BASIC | {1: b"<</Type/Catalog/Pages 2 0 R/Version/1.6>>"}), "1.6 - - 1 hi - 0 0,0,200,100"),
    ("older_catalog_version", assembled(BASIC | {1: b"<</Type/Catalog/Pages 2 0 R/Version/1.2>>"}), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("bytes_before_header", assembled(BASIC, head=b"junk\n%PDF-1.3\n"), "1.3 - - 1 hi - 0 0,0,200,100"),
    ("no_header", assembled(BASIC, head=b"nothing\n"), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("encrypted", assembled(BASIC, b"/Root 1 0 R/Encrypt<</Filter/Standard>>"), "1.4 enc - 1 hi - 0 0,0,200,100"),
    ("older_trailer_has_info", updated(assembled(BASIC | {6: b"<</Title(old)>>"}, b"/Root 1 0 R/Info 6 0 R"), {9: b"null"}, b"/Root 1 0 R"), "1.4 - - 1 hi old 0 0,0,200,100"),
    ("newer_trailer_wins", updated(assembled(BASIC | {6: b"<</Title(old)>>"}, b"/Root 1 0 R/Info 6 0 R"), {9: b"<</Title(new)>>"}, b"/Root 1 0 R/Info 9 0 R"), "1.4 - - 1 hi new 0 0,0,200,100"),
    ("length_too_short", assembled(BASIC | {4: stream(b"BT /F 10 Tf (hi) Tj ET", length=b"3")}), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("length_too_long", assembled(BASIC | {4: stream(b"BT /F 10 Tf (hi) Tj ET", length=b"9999")}), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("length_elsewhere", assembled(BASIC | {4: stream(b"BT /F 10 Tf (hi) Tj ET", length=b"9 0 R"), 9: b"22"}), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("wrong_offset", assembled(BASIC, wrong={4: 7, 3: -2}), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("hybrid", hybrid(), "1.5 - - 1 hi seen 0 0,0,200,100"),
    ("packed_1_2_1", with_xref_stream(BASIC, {6: b"<</Title(in)>>", 10: b"7"}, 7, b"/Root 1 0 R/Info 6 0 R", (1, 2, 1)), "1.5 - - 1 hi in 0 0,0,200,100"),
    ("packed_1_3_2", with_xref_stream(BASIC, {10: b"7", 6: b"<</Title(in)>>"}, 7, b"/Root 1 0 R/Info 6 0 R", (1, 3, 2)), "1.5 - - 1 hi in 0 0,0,200,100"),
    ("stale_member", updated(with_xref_stream(BASIC, {6: b"<</Title(stale)>>", 10: b"7"}, 7, b"/Root 1 0 R/Info 6 0 R", (1, 2, 1)), {6: b"<</Title(fresh)>>"}, b"/Root 1 0 R/Info 6 0 R"), "1.5 - - 1 hi fresh 0 0,0,200,100"),
    ("nothing_but_objects", b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in BASIC.items()), "1.4 - rec 1 hi - 0 0,0,200,100"),
    ("last_of_a_number_counts", b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in [(4, stream(b"BT (no) Tj ET")), *BASIC.items()]), "1.4 - rec 1 hi - 0 0,0,200,100"),
    ("pages_without_a_tree", assembled(BASIC | {1: b"<</Type/Catalog>>", 2: b"<</MediaBox[0 0 30 40]/Rotate 90>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"}), "1.4 - - 1 hi - 90 0,0,30,40"),
    ("tree_with_a_cycle", assembled(BASIC | {2: b"<</Type/Pages/Kids[3 0 R 2 0 R]/Count 2>>"}), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("inherited_from_above", assembled(BASIC | {2: b"<</Type/Pages/Kids[5 0 R]/Rotate -90/MediaBox[50 60 10 20]>>", 5: b"<</Type/Pages/Parent 2 0 R/Kids[3 0 R]>>", 3: b"<</Type/Page/Parent 5 0 R/Contents[4 0 R 4 0 R]>>"}), "1.4 - - 1 hi/hi - 270 10,20,40,40"),
    ("dangling_contents", assembled(BASIC | {3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 200 100]/Contents 99 0 R>>"}), "1.4 - - 1  - 0 0,0,200,100"),
    ("chain_of_references", assembled(BASIC | {3: b"<</Type/Page/Parent 2 0 R/MediaBox 5 0 R/Contents 4 0 R>>", 5: b"6 0 R", 6: b"[0 0 200 100]"}), "1.4 - - 1 hi - 0 0,0,200,100"),
    ("title_in_utf16", assembled(BASIC | {6: b"<</Title<FEFF00C90074>>>"}, b"/Root 1 0 R/Info 6 0 R"), "1.4 - - 1 hi Ét 0 0,0,200,100"),
    ("title_in_pdfdoc", assembled(BASIC | {6: b"<</Title(\\200x\\240)>>"}, b"/Root 1 0 R/Info 6 0 R"), "1.4 - - 1 hi •x€ 0 0,0,200,100"),
]


def read_document(data: bytes) -> str:
    d = Document(data)
    pages = d.pages()
    texts = [e["text"] for p in pages for e in Interpreter(d).page(p) if e["kind"] == "text"]
    title = d.get(d.info.get("Title"))
    box = ",".join(f"{x:g}" for x in pages[0].box("MediaBox") or ())
    return f"{d.version} {'enc' if d.encrypted else '-'} {'rec' if d.recovered else '-'} {len(pages)} {'/'.join(texts)} {title.text if isinstance(title, PdfString) else '-'} {pages[0].rotation} {box}"


SYNTAX: list[Case] = [
    ("nested_brackets", b"(a(b)c)", '{"x":"6128622963"}'),
    ("octal", b"(\\53\\0533\\7)", '{"x":"2b2b3307"}'),
    ("octal_overflow", b"(\\777)", '{"x":"ff"}'),
    ("escapes", b"(\\n\\r\\t\\b\\f\\(\\)\\\\\\q)", '{"x":"0a0d09080c28295c71"}'),
    ("continued_line", b"(a\\\r\nb\\\nc)", '{"x":"616263"}'),
    ("line_ends", b"(a\r\nb\rc\nd)", '{"x":"610a620a630a64"}'),
    ("hex_odd", b"<9>", '{"x":"90"}'),
    ("hex_space", b"<4 8\n65>", '{"x":"4865"}'),
    ("name_escape", b"/A#20B#2f", '{"n":"A B/"}'),
    ("name_bad_escape", b"/A#G1", '{"n":"A#G1"}'),
    ("empty_name", b"/ 1", '{"n":""}'),
    ("numbers", b"[ +17 -98 0 34.5 -3.62 +123.6 4. -.002 .5 ]", "[17,-98,0,34.5,-3.62,123.6,4.0,-0.002,0.5]"),
    ("comments", b"[1 % two ]\n2]", "[1,2]"),
    ("constants", b"[true false null]", "[true,false,null]"),
    ("references", b"[12 0 R 5 0 3 1 R]", '[{"r":12},5,0,{"r":3}]'),
    ("no_space", b"[/A/B(c)<64>1/D]", '[{"n":"A"},{"n":"B"},{"x":"63"},{"x":"64"},1,{"n":"D"}]'),
    ("last_key_wins", b"<</A 1/A 2>>", '{"A":2}'),
    ("nested", b"<</A<</B[1[2]]>>/C null>>", '{"A":{"B":[1,[2]]},"C":null}'),
    ("unterminated", b"<</A 1/B[1 2", '{"A":1,"B":[1,2]}'),
    ("unterminated_string", b"(abc", '{"x":"616263"}'),
    ("missing_value", b"<</A/B>>", '{"A":{"n":"B"}}'),
]


def shown(x) -> object:
    if isinstance(x, Name):
        return {"n": str(x)}
    if isinstance(x, Ref):
        return {"r": x.num}
    if isinstance(x, bytes):
        return {"x": x.hex()}
    if isinstance(x, dict):
        return {str(k): shown(v) for k, v in x.items()}
    return [shown(v) for v in x] if isinstance(x, list) else x


def read_syntax(data: bytes) -> str:
    return json.dumps(shown(Reader(data).object()), separators=(",", ":"))


FILTERS: list[Case] = [
    ("lzw_of_the_specification", b"LZWDecode {} 800B6050220C0C8501", "2D2D2D2D2D412D2D2D42"),
    ("flate_stored", b"FlateDecode {} 7801010500FAFF48656C6C6F058C01F5", "48656C6C6F"),
    ("flate_without_header", b"FlateDecode {} 010500FAFF48656C6C6F", "48656C6C6F"),
    ("flate_truncated", b"FlateDecode {} 7801010500FAFF4865", "4865"),
    ("hex", b"ASCIIHexDecode {} 34382036353E3939", "4865"),
    ("hex_odd", b"ASCIIHexDecode {} 3438373E", "4870"),
    ("base85", b"ASCII85Decode {} 396A716F5E426C62442D7E3E", "4D616E2069732064"),
    ("base85_last_group", b"ASCII85Decode {} 2F637E3E", "2E"),
    ("base85_zeros", b"ASCII85Decode {} 7A0A7E3E", "00000000"),
    ("run_length", b"RunLengthDecode {} 02414243FE588044", "414243585858"),
    ("run_length_longest", b"RunLengthDecode {} 815A80", "5A" * 128),
    ("run_length_without_end", b"RunLengthDecode {} 0041", "41"),
    ("png_rows", b'FlateDecode {"Predictor":15,"Columns":4} 7801011900E6FF0101010101020101010103010101010401010101000909090900000000', "01020304020304050203040503040506" + "09090909"),
    ("tiff_rows", b'FlateDecode {"Predictor":2,"Colors":3,"Columns":2} 7801010600F9FF01020301010100000000', "010203020304"),
]


def read_filter(data: bytes) -> str:
    name, parms, packed = data.decode().split(" ")
    return filters.decode(bytes.fromhex(packed), [(name, json.loads(parms))]).hex().upper()


TO_UNICODE = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00480069> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0058> <0059>] endbfrange"
AROUND = {
    5: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>",
    6: b"<</Type/Font/Subtype/Type1/BaseFont/Odd/Encoding<</Differences[65/B/uni00E9 90/space/Euro]>>>>",
    7: b"<</Type/Font/Subtype/Type0/BaseFont/Wide/Encoding/Identity-H>>",
    8: b"<</Type/Font/Subtype/Type1/BaseFont/Mapped/ToUnicode 9 0 R>>",
    9: stream(TO_UNICODE),
    10: stream(b"q 1 0 0 1 1 1 cm BT /F 5 Tf (in) Tj ET Q /X Do", b"/Type/XObject/Subtype/Form/BBox[0 0 9 9]/Matrix[2 0 0 2 10 20]"),
    11: stream(b"\0" * 8, b"/Type/XObject/Subtype/Image/Width 4/Height 2/ColorSpace/DeviceGray/BitsPerComponent 8"),
    12: b"<</Type/OCG/Name(Lay)>>",
    13: b"<</LW 3/Font[5 0 R 9]>>",
}
RESOURCES = b"<</Font<</F 5 0 R/D 6 0 R/Z 7 0 R/U 8 0 R>>/XObject<</X 10 0 R/I 11 0 R>>/Properties<</P 12 0 R>>/ExtGState<</G 13 0 R>>>>"
LINE = b"0 0 m 1 0 l "

CONTENT: list[Case] = [
    ("curve_c", b"0 0 m 0 3 3 3 3 0 c S", "P1w1 o13:1.5,2.25:3,0"),
    ("curve_v", b"0 0 m 3 3 3 0 v S", "P1w1 o13:1.5,1.125:3,0"),
    ("curve_y", b"0 0 m 0 3 3 0 y S", "P1w1 o13:1.5,1.125:3,0"),
    ("closed_lines", b"1 2 m 4 5 l 7 8 l h S", "P1w1 c3:4,5:7,8"),
    ("rectangle", b"10 20 30 40 re f", "P2w1 c4:40,60:10,60"),
    ("two_subpaths", b"0 0 m 1 1 l 2 2 m 3 3 l B", "P3w1 o2:1,1:1,1 o2:3,3:3,3"),
    ("painting", b"".join(LINE + op + b" " for op in b"S s f F f* B B* b b* n".split()), "; ".join(f"P{p}w1 {c}2:1,0:1,0" for p, c in zip((1, 1, 2, 2, 2, 3, 3, 3, 3, 0), "ocooooocco"))),
    ("clipping", b"0 0 5 5 re W n 1 1 m 2 2 l S", "P0w1 c4:5,5:0,5; P1w1 o2:2,2:2,2"),
    ("graphics_state", b"/G gs 0 0 m 1 0 l S BT (a) Tj ET", "P1w3 o2:1,0:1,0; Ta@0,0/9"),
    ("text_lines", b"BT /F 10 Tf 14 TL 72 700 Td (a) Tj T* (b) Tj (c) ' 1 2 (d) \" [(e) -250 (f)] TJ ET", "Ta@72,700/10; Tb@72,686/10; Tc@72,672/10; Td@72,658/10; Te@72,658/10; Tf@72,658/10"),
    ("leading_of_TD", b"BT /F 8 Tf 5 100 TD (x) Tj 0 -20 TD (y) Tj T* (z) Tj ET", "Tx@5,100/8; Ty@5,80/8; Tz@5,60/8"),
    ("text_matrix", b"BT /F 8 Tf 2 0 0 2 30 40 Tm (x) Tj 5 6 Td (y) Tj ET BT (z) Tj ET", "Tx@30,40/8; Ty@40,52/8; Tz@0,0/8"),
    ("render_mode", b"BT /F 8 Tf 3 Tr (x) Tj ET", "Tx@0,0/8r3"),
    ("saved_states", b"q 2 0 0 2 0 0 cm 3 w q 1 0 0 1 5 5 cm Q 0 0 m 1 0 l S Q Q 0 0 m 1 0 l S", "P1w3[2 0 0 2 0 0] o2:1,0:1,0; P1w1 o2:1,0:1,0"),
    ("turned", b"0 1 -1 0 5 6 cm 2 0 0 3 0 0 cm 0 0 m 1 0 l S", "P1w1[0 2 -3 0 5 6] o2:1,0:1,0"),
    ("image", b"q 40 0 0 20 5 6 cm /I Do Q", "I4x2[40 0 0 20 5 6]"),
    ("inline_image", b"BI /W 4 /H 2 /BPC 8 /CS /G /F /AHx ID 00FF> EI 0 0 m 1 0 l S", "I4x2; P1w1 o2:1,0:1,0"),
    ("inline_image_holds_its_end", b"BI /W 1 /H 1 ID aEIb EI\n0 0 m 1 0 l S", "I1x1; P1w1 o2:1,0:1,0"),
    ("form_within_itself", b"BT /F 7 Tf ET /X Do BT (p) Tj ET", "Tin@0,0/5[2 0 0 2 12 22]; Tp@0,0/7"),
    ("differences", b"BT /D 8 Tf (ABCZ[) Tj ET", "TBéC €@0,0/8"),
    ("codes_of_two_bytes", b"BT /Z 8 Tf <00410042> Tj ET", "TAB@0,0/8"),
    ("to_unicode", b"BT /U 8 Tf <0110122021FF> Tj ET", "THiacXY�@0,0/8"),
    ("win_ansi", b"BT /F 8 Tf <80E9> Tj ET", "T€é@0,0/8"),
    ("marks", b"/OC /P BDC /Span <</Name (in)>> BDC 0 0 m 1 0 l S EMC EMC /A BMC 0 0 m 1 0 l S EMC EMC", "P1w1{Span=in,OC=Lay} o2:1,0:1,0; P1w1{A=None} o2:1,0:1,0"),
    ("many_operands", b"9 " * 70 + b"1 2 3 4 re f", "P2w1 c4:4,6:1,6"),
    ("missing_operands", b"1 2 re 5 w cm Td 0 0 m 1 0 l S", "P1w5 o2:1,0:1,0"),
    ("unknown_operators", b"1 2 foo 0 0 m 1 0 l S", "P1w1 o2:1,0:1,0"),
]


def read_content(data: bytes) -> str:
    d = Document(assembled({**BASIC, 3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]/Contents 4 0 R/Resources %s>>" % RESOURCES, 4: stream(data), **AROUND}))
    at = lambda p: f"{p[0]:g},{p[1]:g}"
    out = []
    for e in Interpreter(d).page(d.pages()[0]):
        turned = "" if tuple(e["ctm"]) == (1, 0, 0, 1, 0, 0) else "[" + " ".join(f"{x:g}" for x in e["ctm"]) + "]"
        tags = "{" + ",".join(f"{t['role']}={t['props']}" for t in e["tags"]) + "}" if e["tags"] else ""
        if e["kind"] == "text":
            out.append(f"T{e['text']}@{at(e['tm'][4:])}/{e['font_size']:g}" + (f"r{e['render_mode']}" if e["render_mode"] else "") + turned + tags)
        elif e["kind"] == "image":
            out.append(f"I{e['img_w']}x{e['img_h']}{turned}{tags}")
        else:
            out.append(f"P{e['paint_op']}w{e['line_width']:g}{turned}{tags} " + " ".join(f"{'c' if c else 'o'}{len(p)}:{at(p[len(p) // 2])}:{at(p[-1])}" for c, p in e["subpaths"]))
    return "; ".join(out)


COLORS: list[Case] = [
    ("name", b"/DeviceCMYK", "DeviceCMYK -"),
    ("spot", b"[/Separation/Gold/DeviceCMYK 9 0 R]", "Separation(Gold) Gold"),
    ("all_is_no_spot", b"[/Separation/All/DeviceCMYK 9 0 R]", "Separation(All) -"),
    ("several", b"[/DeviceN[/Cyan/Gold/Varnish]/DeviceCMYK 9 0 R]", "DeviceN(Cyan,Gold,Varnish) Gold,Varnish"),
    ("indexed", b"[/Indexed[/Separation/Gold/DeviceCMYK 9 0 R]1<00FF>]", "Indexed(Separation(Gold)) Gold"),
    ("profile", b"[/ICCBased 8 0 R]", "ICCBased(4) -"),
    ("calibrated", b"[/CalRGB<<>>]", "CalRGB -"),
]


def read_color(data: bytes) -> str:
    d = Document(assembled(BASIC | {7: data, 8: stream(b"", b"/N 4"), 9: b"<<>>"}))
    return f"{inspect.describe_space(d, Ref(7))} {','.join(sorted(inspect.spot_names(d, Ref(7)))) or '-'}"


def font_file(cmap: bytes, platform: tuple[int, int] = (3, 1), win: tuple[int, int] | None = None) -> bytes:
    """Three glyphs of 500, 600 and 700 units, 2,048 to the em."""
    tables = {
        b"head": b"\0" * 18 + struct.pack(">H", 2048) + b"\0" * 16 + struct.pack(">4h", -10, -20, 1000, 1500) + b"\0" * 10,
        b"hhea": struct.pack(">I2h", 65536, 1500, -400) + b"\0" * 26 + struct.pack(">H", 3),
        b"hmtx": struct.pack(">6H", 500, 0, 600, 0, 700, 0),
        b"maxp": struct.pack(">IH", 65536, 9),
        b"cmap": struct.pack(">HHHHI", 0, 1, *platform, 12) + cmap,
    }
    if win:
        tables[b"OS/2"] = b"\0" * 74 + struct.pack(">HH", *win)
    at, body, head = 12 + 16 * len(tables), b"", struct.pack(">IHHHH", 65536, len(tables), 0, 0, 0)
    for tag, data in tables.items():
        head += struct.pack(">4sIII", tag, 0, at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return head + body


FORMAT_4 = struct.pack(">7H3HH3H3h3H2H", 4, 44, 0, 6, 0, 0, 0, 67, 98, 0xFFFF, 0, 65, 97, 0xFFFF, -64, 0, 1, 0, 4, 0, 2, 1)
FONTS: list[Case] = [
    ("format_0", font_file(struct.pack(">HHH", 0, 262, 0) + bytes(2 if k == 65 else 0 for k in range(256)), (1, 0)), "65>2 widths 244,293,342 line 10.5408,-2.808"),
    ("format_4", font_file(FORMAT_4), "65>1,66>2,67>3,97>2,98>1 widths 244,293,342 line 10.5408,-2.808"),
    ("format_6", font_file(struct.pack(">5H3H", 6, 16, 0, 48, 3, 1, 0, 2)), "48>1,50>2 widths 244,293,342 line 10.5408,-2.808"),
    ("format_12", font_file(struct.pack(">HHIIIIII", 12, 0, 28, 0, 1, 0x1F600, 0x1F601, 1), (3, 10)), "128512>1,128513>2 widths 244,293,342 line 10.5408,-2.808"),
    ("symbols", font_file(struct.pack(">5H1H", 6, 12, 0, 0xF041, 1, 2), (3, 0)), "65>2,61505>2 widths 244,293,342 line 10.5408,-2.808"),
    ("windows_metrics", font_file(FORMAT_4, win=(1900, 500)), "65>1,66>2,67>3,97>2,98>1 widths 244,293,342 line 11.136,-2.928"),
]


def read_font(data: bytes) -> str:
    f = fonts.TrueType(data)
    a, d = f.vertical(12)
    return ",".join(f"{c}>{g}" for c, g in sorted(f.codes.items())) + f" widths {','.join(str(f.width(k)) for k in range(3))} line {a:g},{d:g}"


def segments(*parts: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(x) + 2) + x for m, x in parts)


PIXELS = bytes.fromhex("89504E470D0A1A0A")


def png(kind: int, rows: bytes, *more: tuple[bytes, bytes], size: tuple[int, int] = (2, 1)) -> bytes:
    packed = b"\x78\x01\x01" + struct.pack("<HH", len(rows), 65535 - len(rows)) + rows + struct.pack(">I", _adler(rows))
    chunk = lambda tag, data: struct.pack(">I4s", len(data), tag) + data + b"\0\0\0\0"
    return PIXELS + chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, kind, 0, 0, 0)) + b"".join(chunk(*x) for x in more) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def _adler(data: bytes) -> int:
    a, b = 1, 0
    for x in data:
        a = (a + x) % 65521
        b = (b + a) % 65521
    return b << 16 | a


IMAGES: list[Case] = [
    ("jpeg_baseline", segments((0xE0, b"JFIF\0"), (0xC0, struct.pack(">BHHB", 8, 30, 70, 3) + b"\0" * 9)), "jpeg 70x30 3 8 -"),
    ("jpeg_progressive_adobe", segments((0xEE, b"Adobe\0\0\0\0\0\0\0"), (0xC4, b"\0" * 20), (0xC2, struct.pack(">BHHB", 8, 3, 7, 4) + b"\0" * 12)), "jpeg 7x3 4 8 adobe"),
    ("png_rgb", png(2, bytes([0, 1, 2, 3, 4, 5, 6])), "png 2x1 010203040506 -"),
    ("png_rgba_sub", png(6, bytes([1, 1, 2, 3, 4, 1, 1, 1, 1])), "png 2x1 010203020304 0405"),
    ("png_gray", png(0, bytes([0, 7, 9])), "png 2x1 070707090909 -"),
    ("png_palette", png(3, bytes([0, 1, 0]), (b"PLTE", bytes([1, 2, 3, 4, 5, 6])), (b"tRNS", bytes([128]))), "png 2x1 040506010203 FF80"),
]


def read_image(data: bytes) -> str:
    j = images.jpeg_header(data)
    if j:
        return f"jpeg {j.width}x{j.height} {j.components} {j.bits} {'adobe' if j.adobe else '-'}"
    w, h, rgb, alpha = images.png_pixels(data)
    return f"png {w}x{h} {rgb.hex().upper()} {'-' if alpha is None else alpha.hex().upper()}"


VALUES: list[Case] = [
    ("string", b"(a\\(\\)\\\\)", "(a\\(\\)\\\\)"),
    ("binary_string", b"<0001027F80>", "<0001027F80>"),
    ("name", b"/A#20B#23#2F", "/A#20B#23#2F"),
    ("numbers", b"[1.50 -0.0 100 .3333333 1e5 0.0000001]", "[1.5 0 100 0.333333 0]"),
    ("dictionary", b"<< /A [ 1 2 0 R ] /B null /C true >>", "<</A [1 2 0 R]/B null/C true>>"),
]


def read_value(data: bytes) -> str:
    return writer.value_bytes(Reader(data).object()).decode("latin-1")


#: Text in Courier at size 10: seven letters to a line of 42 points.
LINES: list[Case] = [
    ("words", b"aaa bbb ccc", "aaa bbb|ccc"),
    ("long_word", b"aa ddddddddd e", "aa|ddddddd|dd e"),
    ("paragraphs", b"a\r\nb\n\nc", "a|b||c"),
    ("exact", b"1234567 8", "1234567|8"),
    ("two_spaces", b"aaa  bbb", "aaa |bbb"),
]


def read_lines(data: bytes) -> str:
    return "|".join(canvas.wrap(data.decode(), 42, "Courier", 10))


#: Widths of H, é, a dash and dots in every standard font, from the fonts' published metrics.
STANDARD: list[Case] = [
    (name, name.encode(), str(w))
    for name, w in (
        ("Helvetica", 3278), ("Helvetica-Bold", 3278), ("Helvetica-Oblique", 3278), ("Helvetica-BoldOblique", 3278), ("Times-Roman", 3166), ("Times-Bold", 3222), ("Times-Italic", 2944), ("Times-BoldItalic", 3222),
        ("Courier", 2400), ("Courier-Bold", 2400), ("Courier-Oblique", 2400), ("Courier-BoldOblique", 2400), ("Symbol", 1000), ("ZapfDingbats", 0),
    )
]


def read_standard(data: bytes) -> str:
    return f"{fonts.text_width('Hé—…', data.decode(), 1000):g}"


@lru_cache(maxsize=320)
def _reading(version: int, mask: int) -> tuple[tuple[int, ...], int]:
    """Where the bits of a symbol are read, in order, as flat places, and which of them the mask flips, as one number."""
    n = 17 + 4 * version
    step = 0 if version == 1 else 26 if version == 32 else (version * 4 + (version // 7 + 2) * 2 + 1) // ((version // 7 + 1) * 2) * 2
    centres = [] if version == 1 else [6] + [n - 7 - k * step for k in range(version // 7 + 1)]
    fixed = set()
    for y in range(n):
        for x in range(n):
            corner = y < 9 and x < 9 or y < 9 and x >= n - 8 or y >= n - 8 and x < 9
            near = any(abs(y - a) <= 2 and abs(x - b) <= 2 and (a, b) not in ((6, 6), (6, n - 7), (n - 7, 6)) for a in centres for b in centres)
            if corner or near or 6 in (y, x) or version >= 7 and (y < 6 and x >= n - 11 or x < 6 and y >= n - 11):
                fixed.add((y, x))
    flips = [lambda i, j: (i + j) % 2, lambda i, j: i % 2, lambda i, j: j % 3, lambda i, j: (i + j) % 3, lambda i, j: (i // 2 + j // 3) % 2, lambda i, j: i * j % 2 + i * j % 3, lambda i, j: (i * j % 2 + i * j % 3) % 2, lambda i, j: ((i + j) % 2 + i * j % 3) % 2]
    places, flipped = [], []
    columns = [x for x in range(n - 1, 0, -2) if x > 6] + [5, 3, 1]
    for k, x in enumerate(columns):
        for y in range(n) if k % 2 else range(n - 1, -1, -1):
            for c in (x, x - 1):
                if (y, c) not in fixed:
                    places.append(y * n + c)
                    flipped.append("01"[flips[mask](y, c) == 0])
    return tuple(places), int("".join(flipped), 2)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the field's generator, and of each byte but 0 which power it is."""
    power = [1]
    for _ in range(254):
        power.append(power[-1] << 1 ^ (0x11D if power[-1] > 127 else 0))
    return np.array(power), np.array([0] + [power.index(c) for c in range(1, 256)])


def read_qr(rows: list[str], level_blocks) -> str:
    """The text of a QR symbol, by the specification's reading procedure: format, unmasking, blocks whose syndromes must all be zero, segments. level_blocks(version, level): blocks and check codewords of each."""
    n = len(rows)
    version, dark = (n - 17) // 4, lambda y, x: rows[y][x] == "1"
    around = [(8, 0), (8, 1), (8, 2), (8, 3), (8, 4), (8, 5), (8, 7), (8, 8), (7, 8), (5, 8), (4, 8), (3, 8), (2, 8), (1, 8), (0, 8)]
    beside = [(n - 1 - k, 8) for k in range(7)] + [(8, n - 8 + k) for k in range(8)]
    words = [int("".join("01"[dark(y, x)] for y, x in place), 2) ^ 0b101010000010010 for place in (around, beside)]
    if words[0] != words[1] or not dark(n - 8, 8):
        raise ValueError("format")
    rest = words[0]
    for k in range(14, 9, -1):
        rest ^= (0b10100110111 << k - 10) * (rest >> k & 1)
    if rest:
        raise ValueError("format check")
    level, mask = "MLHQ"[words[0] >> 13], words[0] >> 10 & 7
    places, flipped = _reading(version, mask)
    symbol = "".join(rows)
    bits = f"{int(''.join([symbol[k] for k in places]), 2) ^ flipped:0{len(places)}b}"
    data = [int(bits[k : k + 8], 2) for k in range(0, len(bits) // 8 * 8, 8)]
    blocks, check = level_blocks(version, level)
    whole = len(data) // blocks
    longer = len(data) % blocks
    sizes = [whole - check + (k >= blocks - longer) for k in range(blocks)]
    parts: list[list[int]] = [[] for _ in sizes]
    stream_of = iter(data)
    for k in range(max(sizes)):
        for p, size in zip(parts, sizes):
            if k < size:
                p.append(next(stream_of))
    for _ in range(check):
        for p in parts:
            p.append(next(stream_of))
    power, which = _powers()
    for p in parts:
        c = np.array(p[::-1])
        terms = power[(which[c] + np.arange(check)[:, None] * np.arange(len(c))) % 255]
        if np.bitwise_xor.reduce(terms * (c > 0), axis=1).any():
            raise ValueError("syndrome")
    said = "".join(f"{c:08b}" for p, size in zip(parts, sizes) for c in p[:size])
    at = 0

    def take(width: int) -> int:
        nonlocal at
        at += width
        return int(said[at - width : at], 2)

    kind, wide = take(4), (version > 9) + (version > 26)
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
    if kind == 4:
        return bytes(take(8) for _ in range(take((8, 16, 16)[wide]))).decode("latin-1")
    count, out = take(((10, 12, 14) if kind == 1 else (9, 11, 13))[wide]), ""
    while len(out) < count:
        left = count - len(out)
        if kind == 1:
            m = min(3, left)
            out += str(take((4, 7, 10)[m - 1])).zfill(m)
        elif left > 1:
            pair = take(11)
            out += letters[pair // 45] + letters[pair % 45]
        else:
            out += letters[take(6)]
    return out


AREAS: dict[str, tuple[list[Case], Callable[[bytes], str]]] = {
    "documents": (DOCUMENTS, read_document),
    "syntax": (SYNTAX, read_syntax),
    "filters": (FILTERS, read_filter),
    "content": (CONTENT, read_content),
    "colors": (COLORS, read_color),
    "fonts": (FONTS, read_font),
    "images": (IMAGES, read_image),
    "values": (VALUES, read_value),
    "lines": (LINES, read_lines),
    "standard_fonts": (STANDARD, read_standard),
}


def read(spark: SparkSession, area: str) -> DataFrame:
    """name, value: what our kernels read from the cases of an area."""
    cases, reader = AREAS[area]
    rows = spark.createDataFrame([(n, bytearray(data)) for n, data, _ in cases], "name string, data binary")
    return kernel(spread(rows), lambda name, data: [(name, reader(bytes(data)))], "name string, value string")


def expected(area: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(n)}, {quoted(x)})" for n, _, x in AREAS[area][0]) + ") AS t(name, value)"
