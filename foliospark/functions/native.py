"""Scalar functions as column expressions, within the JVM: geometry, rotation, text widths, barcodes, QR versions, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.kernels import barcode, fonts, qr

# ---- geometry ----


def matrix(a, b, c, d, e, f) -> Column:
    as_column = lambda x: (x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    return F.struct(*(as_column(x).alias(n) for n, x in zip("abcdef", (a, b, c, d, e, f))))


def identity() -> Column:
    return matrix(1, 0, 0, 1, 0, 0)


def translate(x, y) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def scale(x, y) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def multiply(m: Column, n: Column) -> Column:
    """m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def transform_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def scale_x(m: Column) -> Column:
    return F.sqrt(m["a"] * m["a"] + m["b"] * m["b"])


def scale_y(m: Column) -> Column:
    return F.sqrt(m["c"] * m["c"] + m["d"] * m["d"])


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From two corners in any order."""
    return F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("w"), F.abs(y1 - y0).alias("h"))


def contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x"], r["x"] + r["w"]) & y.between(r["y"], r["y"] + r["h"])


def inches(points: Column) -> Column:
    return points / 72


def points(inch: Column) -> Column:
    return inch * 72


def rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270."""
    return (F.floor(F.pmod(degrees, F.lit(360)) / 90) * 90).cast("int")


def curve(a: Column, b: Column, c: Column, d: Column, steps: int = 12) -> Column:
    """One coordinate of a Bézier curve at equal steps."""
    t = lambda k: k / F.lit(float(steps))
    u = lambda k: 1 - k / F.lit(float(steps))
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: u(k) * u(k) * u(k) * a + 3 * u(k) * u(k) * t(k) * b + 3 * u(k) * t(k) * t(k) * c + t(k) * t(k) * t(k) * d)


# ---- text ----


def text_width(text: Column, font: str = "Helvetica", size: float = 12.0) -> Column:
    """Width of the WinAnsi characters of a text; others have none."""
    width = {c: fonts.widths(font)[code[0]] for k in range(32, 0x2123) if (code := fonts.encode(c := chr(k)))}
    low = F.lit([int(width.get(chr(k), 0)) for k in range(256)])
    high = F.create_map(*(F.lit(x) for c, w in width.items() if ord(c) > 255 for x in (c, int(w))))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + F.when(c < "\u0100", F.get(low, F.ascii(c))).otherwise(F.coalesce(F.try_element_at(high, c), F.lit(0)))) * F.lit(size) / 1000


def column_widths(percents: Column, width: Column) -> Column:
    return F.transform(percents, lambda p: width * p / F.aggregate(percents, F.lit(0.0), lambda s, x: s + x))


def table_pages(rows: Column, fresh: int, later: int) -> Column:
    """Pages of a table with `fresh` rows on the first page and `later` on each other."""
    return F.when(rows <= fresh, 1).otherwise(1 + F.ceil((rows - fresh) / later)).cast("int")


# ---- barcodes ----


def _digits(content: Column) -> Column:
    return F.transform(F.filter(F.split(content, ""), lambda c: c != ""), lambda c: c.cast("int"))


def ean_check(digits: Column) -> Column:
    """Check digit of a string of digits: weights 3 and 1 from the right."""
    weighted = F.transform(F.reverse(_digits(digits)), lambda d, k: d * F.when(k % 2 == 0, 3).otherwise(1))
    return F.pmod(-F.aggregate(weighted, F.lit(0), lambda s, x: s + x), F.lit(10)).cast("int")


def ean13(digits: Column) -> Column:
    """Modules of an EAN-13 symbol of 12 digits."""
    swap = lambda c: F.translate(c, "01", "10")
    code = F.array(*map(F.lit, barcode.EAN_L))
    parity = F.array(*map(F.lit, barcode.EAN_PARITY))
    whole = F.concat(digits, ean_check(digits).cast("string"))
    d = _digits(whole)
    sides = F.get(parity, F.get(d, F.lit(0)))
    left = F.transform(F.slice(d, 2, 6), lambda x, k: F.when(F.substring(sides, k + 1, F.lit(1)) == "L", F.get(code, x)).otherwise(F.reverse(swap(F.get(code, x)))))
    right = F.transform(F.slice(d, 8, 6), lambda x: swap(F.get(code, x)))
    return F.concat(F.lit("101"), F.array_join(left, ""), F.lit("01010"), F.array_join(right, ""), F.lit("101"))


def upca(digits: Column) -> Column:
    return ean13(F.concat(F.lit("0"), digits))


def code39(content: Column) -> Column:
    """Modules of a Code 39 symbol; what the code lacks gives null."""
    shape = lambda p: "".join(("1", "0")[k % 2] * (3 if w == "w" else 1) for k, w in enumerate(p))
    table = F.create_map(*(x for c, p in barcode.CODE39.items() for x in (F.lit(c), F.lit(shape(p)))))
    letters = F.filter(F.split(F.concat(F.lit("*"), F.upper(content), F.lit("*")), ""), lambda c: c != "")
    shapes = F.transform(letters, lambda c: F.try_element_at(table, c))
    return F.when(~F.exists(shapes, lambda s: s.isNull()), F.array_join(shapes, "0"))


def code39_check(content: Column) -> Column:
    order = "".join(barcode.CODE39)
    letters = F.filter(F.split(F.upper(content), ""), lambda c: c != "")
    return (F.aggregate(F.transform(letters, lambda c: F.instr(F.lit(order), c) - 1), F.lit(0), lambda s, x: s + x) % 43).cast("int")


def itf(digits: Column) -> Column:
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    d = _digits(even)
    code = F.array(*map(F.lit, barcode.ITF))
    pairs = F.transform(F.sequence(F.lit(0), (F.size(d) / 2).cast("int") - 1), lambda k: F.struct(F.get(code, F.get(d, (2 * k).cast("int"))).alias("a"), F.get(code, F.get(d, (2 * k + 1).cast("int"))).alias("b")))
    one = lambda s, k, c: F.when(F.substring(s, k, F.lit(1)) == "w", c * 3).otherwise(c)
    drawn = F.transform(pairs, lambda p: F.concat(*(x for k in range(1, 6) for x in (one(p["a"], F.lit(k), "1"), one(p["b"], F.lit(k), "0")))))
    return F.concat(F.lit("1010"), F.array_join(drawn, ""), F.lit("11101"))


def code128_check(digits: Column) -> Column:
    """Check value of an even run of digits in set C."""
    n = (F.length(digits) / 2).cast("int")
    values = F.transform(F.sequence(F.lit(1), n), lambda k: k * F.substring(digits, 2 * k - 1, F.lit(2)).cast("int"))
    return (F.aggregate(values, F.lit(105), lambda s, x: s + x) % 103).cast("int")


def bar_count(modules: Column) -> Column:
    return F.size(F.regexp_extract_all(modules, F.lit("1+"), F.lit(0)))


def qr_version(content: Column, level: str = "M") -> Column:
    """Smallest version whose data codewords hold the body and the reserve; null beyond version 40."""
    n = F.length(content)
    bits = (
        F.when(content.rlike("^[0-9]+$"), F.floor(n / 3) * 10 + F.when(n % 3 == 1, 4).when(n % 3 == 2, 7).otherwise(0))
        .when(content.rlike(r"^[0-9A-Z $%*+\-./:]+$"), F.floor(n / 2) * 11 + n % 2 * 6)
        .otherwise(n * 8)
    )
    need = F.ceil(bits / 8) + qr.RESERVE
    out = F.when(F.lit(False), 0)
    for v in range(1, 41):
        out = out.when(need <= qr.data_codewords(v, level), v)
    return out


# ---- arrays: items by place, and arrays with items added, set or taken out ----


def item(values: Column, k: Column) -> Column:
    """The item at a place from 0; null out of range."""
    return F.when(k >= 0, F.get(values, k))


def appended(values: Column, x: Column) -> Column:
    return F.array_append(values, x)


def inserted(values: Column, k: Column, x: Column) -> Column:
    return F.concat(F.slice(values, F.lit(1), k), F.array(x), F.slice(values, k + 1, F.size(values)))


def replaced(values: Column, k: Column, x: Column) -> Column:
    return F.transform(values, lambda v, i: F.when(i == k, x).otherwise(v))


def without_first(values: Column, x: Column) -> Column:
    """Without the first item that equals x."""
    at = F.array_position(values, x)
    return F.when(at > 0, F.filter(values, lambda v, i: i + 1 != at)).otherwise(values)


# ---- hashes and codecs ----


def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def ascii_hex_decode(text: Column) -> Column:
    """Bytes of a hexadecimal string up to >, white space skipped, an odd last digit filled with 0."""
    digits = F.regexp_replace(F.split(text, ">")[0], "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def effective_version(header: Column, catalog: Column) -> Column:
    return F.greatest(header, catalog)


def header_version(content: Column) -> Column:
    found = F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"%PDF-(\d\.\d)", 1)
    return F.when(found != "", found).otherwise("1.4")


def unsupported_filter(filters: Column) -> Column:
    known = F.array(*map(F.lit, ("FlateDecode", "LZWDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode")))
    return F.exists(filters, lambda f: ~F.array_contains(known, f))
