"""Tokens and objects from bytes. Lenient: damage ends an array or dictionary, it never raises."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

from foliospark.kernels.objects import Keyword, Name, PdfString, Ref

SPACE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
DEPTH = 200

_skip = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
#: One match for what most tokens are: space, then a name, a plain integer, a plain real or another regular word; else a bracket follows.
_lexeme = re.compile(
    rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*(?:/([^\0\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|([+-]?\d+)(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)|([+-]?\d+\.\d*)(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)|([^\0\t\n\f\r ()<>\[\]{}/%]+))?"
)
#: The same where an object begins: an integer takes the rest of a reference with it.
_item = re.compile(
    rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*(?:/([^\0\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|([+-]?\d+)(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)(?:[\0\t\n\f\r ]+(\d{1,10})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%]))?"
    rb"|([+-]?\d+\.\d*)(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)|([^\0\t\n\f\r ()<>\[\]{}/%]+))?"
)
_regular = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_number = re.compile(rb"[+-]*(?:\d+(?:\.\d*)?|\.\d*)-?\d*$")
_hex_run = re.compile(rb"[^>]*")
_plain = re.compile(rb"[^()\\\r]*")
_reference = re.compile(rb"[\0\t\n\f\r ]+(\d{1,10})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_constants = {b"true": True, b"false": False, b"null": None}
_escapes = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class End:
    """Past the last token; one object, in workers too."""

    def __reduce__(self):
        return "END"


END = End()


@lru_cache(maxsize=8192)
def _name(word: bytes) -> Name:
    if b"#" in word:
        word = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word)
    try:
        return Name(word.decode("utf-8"))
    except UnicodeDecodeError:
        return Name(word.decode("latin-1"))


class Reader:
    def __init__(self, data: bytes, pos: int = 0, end: int | None = None):
        self.data, self.pos, self.end = data, pos, len(data) if end is None else end

    def skip(self) -> None:
        self.pos = min(_skip.match(self.data, self.pos, self.end).end(), self.end)

    def token(self) -> Any:
        """A number, Name, PdfString or Keyword (brackets included), or END."""
        data = self.data
        m = _lexeme.match(data, self.pos, self.end)
        self.pos = at = m.end()
        kind = m.lastindex
        if kind == 1:
            return _name(m[1])
        if kind == 2:
            return int(m[2])
        if kind == 3:
            return float(m[3])
        if kind == 4:
            return self._number(m[4]) if m[4][0] in b"+-.0123456789" else Keyword(m[4])
        if at >= self.end:
            return END
        c = data[at]
        if c == 0x28:
            return self._literal()
        two = data[at : at + 2]
        if c == 0x3C and two != b"<<":
            return self._hex()
        self.pos += 2 if two in (b"<<", b">>") else 1
        return Keyword(two if two in (b"<<", b">>") else data[at : at + 1])

    def _number(self, word: bytes) -> Any:
        if not _number.match(word):
            return Keyword(word)
        sign = -1 if word.count(b"-", 0, len(word) - len(word.lstrip(b"+-"))) % 2 else 1
        body = word.lstrip(b"+-").split(b"-")[0]  # what follows a stray minus is dropped
        if b"." in body:
            return sign * float(body) if body != b"." else 0.0
        return sign * int(body)

    def _hex(self) -> PdfString:
        run = _hex_run.match(self.data, self.pos + 1, self.end)[0]
        self.pos = min(self.pos + 2 + len(run), self.end)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", run)
        out = PdfString(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        out.hexed = True
        return out

    def _literal(self) -> PdfString:
        data, at, depth, out = self.data, self.pos + 1, 1, bytearray()
        end = _plain.match(data, at, self.end).end()
        if end < self.end and data[end] == 0x29:
            self.pos = end + 1
            return PdfString(data[at:end])
        while at < self.end:
            run = _plain.match(data, at, self.end)[0]
            out += run
            at += len(run)
            if at >= self.end:
                break
            c = data[at]
            at += 1
            if c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(c)
            elif c == 0x0D:
                at += data[at : at + 1] == b"\n"
                out += b"\n"
            else:
                e = data[at] if at < self.end else 0x5C
                at += 1
                if e in _escapes:
                    out += _escapes[e]
                elif 0x30 <= e <= 0x37:
                    octal = re.compile(rb"[0-7]{1,3}").match(data, at - 1)[0]
                    at += len(octal) - 1
                    out.append(int(octal, 8) & 255)
                elif e == 0x0D:
                    at += data[at : at + 1] == b"\n"
                elif e != 0x0A:
                    out.append(e)
        self.pos = min(at, self.end)
        return PdfString(bytes(out))

    def object(self, depth: int = 0) -> Any:
        """The next object; a Keyword if the next token isn't one's beginning, END at the end."""
        m = _item.match(self.data, self.pos, self.end)
        kind = m.lastindex
        if kind == 2:
            self.pos = m.end()
            return int(m[2])
        if kind == 1:
            self.pos = m.end()
            return _name(m[1])
        if kind == 3:
            num = int(m[2])
            if num >= 0:
                self.pos = m.end()
                return Ref(num, int(m[3]))
            self.pos = m.end(2)
            return num
        if kind == 4:
            self.pos = m.end()
            return float(m[4])
        if kind is None:
            self.pos = at = m.end()
            if at >= self.end:
                return END
            c = self.data[at]
            if c == 0x28:
                return self._literal()
            if c == 0x5B:
                self.pos += 1
                return self._array(depth)
            if c == 0x3C and self.data[at + 1 : at + 2] == b"<":
                self.pos += 2
                return self._dictionary(depth)
        elif m[5][0] not in b"+-.0123456789":
            self.pos = m.end()
            return _constants.get(m[5]) if m[5] in _constants else Keyword(m[5])
        t = self.token()
        if type(t) is int and t >= 0:
            m = _reference.match(self.data, self.pos, self.end)
            if m:
                self.pos = m.end()
                return Ref(t, int(m[1]))
            return t
        return t

    def _array(self, depth: int) -> list:
        out: list = []
        while depth < DEPTH:
            x = self.object(depth + 1)
            if x is END or isinstance(x, Keyword):
                if x is not END and x not in (b"]", b">>", b")", b"}"):
                    if x in (b"endobj", b"stream", b"obj"):
                        self.pos -= len(x)
                        break
                    continue
                break
            out.append(x)
        return out

    def _dictionary(self, depth: int) -> dict:
        out: dict = {}
        while depth < DEPTH:
            key = self.token()
            if key is END or isinstance(key, Keyword) and key in (b">>", b"endobj", b"stream"):
                if key is not END and key != b">>":
                    self.pos -= len(key)
                break
            if not isinstance(key, Name):
                continue
            before = self.pos
            x = self.object(depth + 1)
            if x is END or isinstance(x, Keyword):
                self.pos = before
                continue
            out[key] = x
        return out
