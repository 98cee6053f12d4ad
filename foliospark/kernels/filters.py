"""Stream filters."""

from __future__ import annotations

import re
import struct
import zlib
from typing import Any

import numpy as np

from foliospark.kernels.objects import Name, integer

# Full and abbreviated filter names.
SHORT = {"A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "Fl": "FlateDecode", "LZW": "LZWDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}


def _inflated(data: bytes, bits: int) -> tuple[bytes, bool]:
    """What inflates, up to the byte that is damaged, and whether all of it did."""
    d = zlib.decompressobj(bits)
    try:
        return d.decompress(data) + d.flush(), True
    except zlib.error:
        pass
    d, out = zlib.decompressobj(bits), bytearray()
    for at in range(0, len(data), 1024):
        before = d.copy()
        try:
            out += d.decompress(data[at : at + 1024])
        except zlib.error:
            for k in range(at, min(at + 1024, len(data))):
                try:
                    out += before.decompress(data[k : k + 1])
                except zlib.error:
                    return bytes(out), False
    return bytes(out + d.flush()), True


def flate_decode(data: bytes) -> bytes:
    """zlib, else raw deflate; of a truncated or damaged stream what came out before, whatever its checksum."""
    out, whole = _inflated(data, 15)
    return out if whole else max(out, _inflated(data, -15)[0], key=len)


def flate_encode(data: bytes) -> bytes:
    return zlib.compress(data, 6)


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends. Width grows as the format says."""
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    out, before, width, held, bits = bytearray(), None, 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            before, width = None, 9
            continue
        if code < len(table):
            piece = table[code]
        elif before is not None and code == len(table):
            piece = before + before[:1]
        else:
            break
        out += piece
        if before is not None and len(table) < 4096:
            table.append(before + piece[:1])
        before = piece
        size = len(table) + early
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def ascii_hex_decode(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85_decode(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _group85(group)
                group = []
    if len(group) > 1:
        out += _group85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _group85(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    return struct.pack(">I", value & 0xFFFFFFFF)


def run_length_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def png_unpredict(data: bytes, colors: int, bits: int, columns: int) -> bytes:
    """Undoes the row filters None, Sub, Up, Average and Paeth. A last short row is filled up with zeros."""
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    above = bytearray(width)
    out = bytearray()
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        if kind == 1:
            for k in range(step, width):
                row[k] = (row[k] + row[k - step]) & 255
        elif kind == 2:
            row = bytearray((np.frombuffer(bytes(row), np.uint8) + np.frombuffer(bytes(above), np.uint8)).tobytes())
        elif kind == 3:
            for k in range(width):
                row[k] = (row[k] + ((row[k - step] if k >= step else 0) + above[k]) // 2) & 255
        elif kind == 4:
            for k in range(width):
                a, b, c = (row[k - step], above[k], above[k - step]) if k >= step else (0, above[k], 0)
                near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))
                row[k] = (row[k] + near[0][2]) & 255
        out += row
        above = row
    return bytes(out)


def tiff_unpredict(data: bytes, colors: int, bits: int, columns: int) -> bytes:
    width = colors * columns
    if bits != 8 or not width:
        return data
    whole = len(data) // width * width
    rows = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
    return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[whole:]


def unpredict(data: bytes, parms: dict) -> bytes:
    predictor = integer(parms.get("Predictor"), 1)
    shape = (integer(parms.get("Colors"), 1), integer(parms.get("BitsPerComponent"), 8), integer(parms.get("Columns"), 1))
    return png_unpredict(data, *shape) if predictor >= 10 else tiff_unpredict(data, *shape) if predictor == 2 else data


def chain(d: dict, get=lambda x: x) -> list[tuple[str, dict]]:
    """(filter, parameters) of a stream dictionary, abbreviations written out."""
    names = get(d.get("Filter", d.get("F")))
    parms = get(d.get("DecodeParms", d.get("DP")))
    names = names if isinstance(names, list) else [] if names is None else [names]
    parms = parms if isinstance(parms, list) else [parms]
    out = []
    for k, n in enumerate(names):
        n = get(n)
        p = get(parms[k]) if k < len(parms) else None
        if isinstance(n, Name):
            out.append((SHORT.get(n, str(n)), {x: get(y) for x, y in p.items()} if isinstance(p, dict) else {}))
    return out


DECODERS: dict[str, Any] = {
    "FlateDecode": lambda data, p: unpredict(flate_decode(data), p),
    "LZWDecode": lambda data, p: unpredict(lzw_decode(data, integer(p.get("EarlyChange"), 1)), p),
    "ASCIIHexDecode": lambda data, p: ascii_hex_decode(data),
    "ASCII85Decode": lambda data, p: ascii85_decode(data),
    "RunLengthDecode": lambda data, p: run_length_decode(data),
}


def decode(data: bytes, filters: list[tuple[str, dict]]) -> bytes | None:
    """None if a filter isn't supported (the image codecs)."""
    for name, parms in filters:
        if name not in DECODERS:
            return None
        data = DECODERS[name](data, parms)
    return data
