"""Image objects: JPEG headers, PNG decoding, building and replacing."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

from foliospark.kernels import filters
from foliospark.kernels.objects import Name, Ref, Stream
from foliospark.kernels.writer import Builder


class Jpeg(NamedTuple):
    width: int
    height: int
    components: int
    bits: int
    adobe: bool


def jpeg_header(data: bytes) -> Jpeg | None:
    """Size, components and the Adobe mark, from the segments before the scan."""
    if data[:2] != b"\xff\xd8":
        return None
    at, adobe = 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark in (0xD9, 0xDA):
            return None
        n = struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xEE and data[at + 4 : at + 9] == b"Adobe":
            adobe = True
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            bits, h, w, c = struct.unpack_from(">BHHB", data, at + 4)
            later = data.find(b"\xff\xee", at + n)
            return Jpeg(w, h, c, bits, adobe or later > 0 and data[later + 4 : later + 9] == b"Adobe")
        at += 2 + n
    return None


def png_pixels(data: bytes) -> tuple[int, int, bytes, bytes | None]:
    """(width, height, RGB, alpha or None) of a PNG of 8 bits a channel, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, clear = 8, b"", b"", b""
    w = h = bits = kind = lace = 0
    while at + 8 <= len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if tag == b"IHDR":
            w, h, bits, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif tag == b"PLTE":
            palette = body
        elif tag == b"tRNS":
            clear = body
        elif tag == b"IDAT":
            packed += body
        at += 12 + n
    if bits != 8 or lace:
        raise ValueError("only 8 bits a channel, not interlaced")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = filters.png_unpredict(zlib.decompress(packed), channels, 8, w)
    px = [raw[k::channels] for k in range(channels)]
    if kind == 3:
        table = [palette[3 * v : 3 * v + 3] for v in range(len(palette) // 3)]
        alpha = bytes(clear[v] if v < len(clear) else 255 for v in px[0]) if clear else None
        return w, h, b"".join(table[v] for v in px[0]), alpha
    rgb = bytes(v for pair in zip(*([px[0]] * 3 if kind in (0, 4) else px[:3])) for v in pair)
    return w, h, rgb, px[-1] if kind in (4, 6) else None


def image(target: Builder, data: bytes) -> Ref:
    """An image object from a JPEG, passed through, or from a PNG, as RGB with a soft mask for its alpha."""
    j = jpeg_header(data)
    if j:
        d = {"Width": j.width, "Height": j.height, "BitsPerComponent": j.bits, "ColorSpace": Name({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[j.components]), "Filter": Name("DCTDecode")}
        if j.components == 4 and j.adobe:
            d["Decode"] = [1, 0] * 4
        return target.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), **d}, data))
    w, h, rgb, alpha = png_pixels(data)
    more = {"SMask": pixels(target, w, h, alpha, "DeviceGray")} if alpha is not None else {}
    return pixels(target, w, h, rgb, "DeviceRGB", **more)


def pixels(target: Builder, w: int, h: int, data: bytes, space: str = "DeviceRGB", **more) -> Ref:
    return target.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "BitsPerComponent": 8, "ColorSpace": Name(space), **more}, data))


def replace_image(target: Builder, ref: Ref, data: bytes) -> None:
    """The same object with another picture."""
    target.put(ref, target.get(image(target, data)))


# Extensions by filter.
EXTENSIONS = {"DCTDecode": "jpg", "JPXDecode": "jp2", "CCITTFaxDecode": "tif", "JBIG2Decode": "jbig2"}


def extension(names: list[str]) -> str:
    return next((EXTENSIONS[n] for n in names if n in EXTENSIONS), "raw")


def payload(raw: bytes, filters_of: list[tuple[str, dict]]) -> bytes:
    """The stored image without the wrapping that can be undone: pixels, or the bytes of an image codec as they are."""
    whole = filters.decode(raw, filters_of)
    return raw if whole is None else whole
