"""Spans of JSON values in bytes, which are never decoded and encoded again.

A span (start, end, kind) covers the bytes of a value. A container's extent is found by counting
brackets outside strings; what is between is looked at only when its members are asked for.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAX_DEPTH = 128
_WS = re.compile(rb"[ \t\n\r]*")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_PREFIX = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?")
_MARK = re.compile(rb'["\[\]{}]')
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_NAMED = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_LITERALS = ((b"true", "bool"), (b"false", "bool"), (b"null", "null"))


class ScanError(ValueError):
    pass


class Span(NamedTuple):
    start: int
    end: int
    kind: str


class Member(NamedTuple):
    key: str
    key_span: tuple[int, int]
    value: Span


def skip_ws(b: bytes, i: int) -> int:
    return _WS.match(b, i).end()


def scan_string(b: bytes, i: int) -> int:
    if not (m := _STRING.match(b, i)):
        raise ScanError("string")
    return m.end()


def scan_number(b: bytes, i: int) -> int:
    m, p = _NUMBER.match(b, i), _PREFIX.match(b, i)
    if not m or m.end() < p.end():
        raise ScanError("number")
    return m.end()


def scan_value(b: bytes, i: int) -> Span:
    c = b[i : i + 1]
    if c == b'"':
        return Span(i, scan_string(b, i), "string")
    if c in (b"{", b"["):
        depth, at = 0, i
        while m := _MARK.search(b, at):
            at, x = m.end(), m[0]
            if x == b'"':
                at = scan_string(b, m.start())
            elif x in b"{[":
                depth += 1
                if depth > MAX_DEPTH:
                    raise ScanError("depth")
            else:
                depth -= 1
                if not depth:
                    if x != (b"}" if c == b"{" else b"]"):
                        raise ScanError("bracket")
                    return Span(i, at, "object" if c == b"{" else "array")
        raise ScanError("open")
    for word, kind in _LITERALS:
        if b.startswith(word, i):
            return Span(i, i + len(word), kind)
    return Span(i, scan_number(b, i), "number")


def _items(b: bytes, span: Span, one):
    """What lies between the brackets of a container, separated by commas."""
    at, end = skip_ws(b, span.start + 1), span.end - 1
    if at == end:
        return []
    out = []
    while True:
        item, at = one(at)
        at = skip_ws(b, at)
        if at > end:
            raise ScanError("overrun")
        out.append(item)
        if at == end:
            return out
        if b[at : at + 1] != b",":
            raise ScanError("comma")
        at = skip_ws(b, at + 1)


def members(b: bytes, span: Span) -> list[Member]:
    def one(at: int):
        end = scan_string(b, at)
        colon = skip_ws(b, end)
        if b[colon : colon + 1] != b":":
            raise ScanError("colon")
        v = scan_value(b, skip_ws(b, colon + 1))
        return Member(decode_string(b[at:end]), (at, end), v), v.end

    return _items(b, span, one)


def elements(b: bytes, span: Span) -> list[Span]:
    def one(at: int):
        v = scan_value(b, at)
        return v, v.end

    return _items(b, span, one)


def scan_document(b: bytes) -> Span:
    v = scan_value(b, skip_ws(b, 0))
    if v.kind != "object" or skip_ws(b, v.end) != len(b):
        raise ScanError("document")
    return v


def decode_string(raw: bytes) -> str:
    """The text of a scanned string; surrogates must come in pairs."""
    try:
        text = raw[1:-1].decode()
    except UnicodeDecodeError as e:
        raise ScanError("utf-8") from e
    if "\\" not in text:
        return text
    out = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" else _NAMED[m[1]], text)
    try:
        return out.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError as e:
        raise ScanError("surrogate") from e


def _check(b: bytes, v: Span) -> None:
    stack = [v]
    while stack:
        x = stack.pop()
        if x.kind == "string":
            decode_string(b[x.start : x.end])
        elif x.kind == "object":
            stack += [m.value for m in members(b, x)]
        elif x.kind == "array":
            stack += elements(b, x)


def valid(b: bytes) -> bool:
    """Whether the whole text is one object, all the way down."""
    try:
        _check(b, scan_document(b))
    except ScanError:
        return False
    return True
