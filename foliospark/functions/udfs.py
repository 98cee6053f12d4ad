"""Arrow-batched functions where the JVM has none: stream filters, barcodes, QR, text wrapping, fonts and images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.kernels import barcode, canvas, filters, images, qr
from foliospark.kernels.content import font_decoder  # noqa: F401 - part of this module's surface
from foliospark.kernels.fonts import TrueType
from foliospark.kernels.syntax import Reader
from foliospark.kernels.writer import string_bytes


def _each(kind, fn):
    """fn over a column; null for null, and for what fn can't do (ValueError)."""

    def safe(x):
        try:
            return None if x is None else fn(x)
        except ValueError:
            return None

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([safe(x) for x in s], dtype=object)

    return run


def decode(raw: Column, names: list[str], parms: dict | None = None) -> Column:
    """Bytes after a chain of filters; null if one isn't supported."""
    return _each(T.BinaryType(), lambda x: filters.decode(bytes(x), [(n, parms or {}) for n in names]))(raw)


def encode_flate(raw: Column) -> Column:
    return _each(T.BinaryType(), lambda x: filters.flate_encode(bytes(x)))(raw)


def literal_string(raw: Column) -> Column:
    return _each(T.BinaryType(), lambda x: string_bytes(bytes(x)))(raw)


def read_string(raw: Column) -> Column:
    return _each(T.BinaryType(), lambda x: bytes(Reader(bytes(x)).token()))(raw)


def barcode_modules(content: Column, kind: str) -> Column:
    return _each(T.StringType(), lambda x: barcode.encode(x, kind))(content)


def qr_rows(content: Column, level: str = "M") -> Column:
    return _each(T.ArrayType(T.StringType()), lambda x: qr.rows(x, level))(content)


def wrapped_lines(text: Column, width: float, font: str = "Helvetica", size: float = 12) -> Column:
    return _each(T.ArrayType(T.StringType()), lambda x: canvas.wrap(x, width, font, size))(text)


def jpeg_header(data: Column) -> Column:
    kind = T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "components", "bits")])

    def one(x):
        j = images.jpeg_header(bytes(x))
        return None if j is None else {"width": j.width, "height": j.height, "components": j.components, "bits": j.bits}

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) or dict.fromkeys(("width", "height", "components", "bits")) for x in s], columns=["width", "height", "components", "bits"])

    return run(data)


def font_cmap(data: Column) -> Column:
    return _each(T.MapType(T.IntegerType(), T.IntegerType()), lambda x: TrueType(bytes(x)).codes)(data)
