"""A lenient JSON reader: events up to the first malformed token."""

from __future__ import annotations

import re
from collections.abc import Iterator

_BLANK = b" \t\n\r"
_NUMBER = re.compile(rb"[-+.eE0-9]+")
_PLAIN = re.compile(rb'[^"\\]*')
_SIMPLE = {ord('"'): b'"', ord("\\"): b"\\", ord("/"): b"/", ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class Stop(Exception):
    """The input is malformed or has ended."""


def _hex(data: bytes, at: int) -> int:
    raw = data[at : at + 4]
    if len(raw) < 4 or not re.fullmatch(rb"\+?[0-9a-fA-F]+", raw):
        raise Stop
    return int(raw, 16)


def _string(data: bytes, at: int) -> tuple[str, int]:
    """The string whose content begins at ``at``, and the place after its quote."""
    out = []
    while True:
        m = _PLAIN.match(data, at)
        out.append(m[0])
        at = m.end()
        if at >= len(data):
            raise Stop
        if data[at] == 0x22:
            try:
                return b"".join(out).decode(), at + 1
            except UnicodeDecodeError:
                raise Stop from None
        if at + 1 >= len(data):
            raise Stop
        kind = data[at + 1]
        if kind in _SIMPLE:
            out.append(_SIMPLE[kind])
            at += 2
        elif kind == ord("u"):
            code, at = _hex(data, at + 2), at + 6
            if 0xD800 <= code < 0xDC00:
                if data[at : at + 2] != b"\\u" or not 0xDC00 <= (low := _hex(data, at + 2)) < 0xE000:
                    raise Stop
                code, at = 0x10000 + ((code - 0xD800) << 10 | low - 0xDC00), at + 6
            elif 0xDC00 <= code < 0xE000:
                raise Stop
            out.append(chr(code).encode())
        else:
            raise Stop


def _events(data: bytes) -> Iterator[tuple[str, str | None]]:
    at, depth, want_key, separator = 0, [], False, False
    while True:
        while at < len(data) and data[at] in _BLANK:
            at += 1
        if at >= len(data):
            raise Stop
        c = data[at : at + 1]
        if separator and c == b",":
            separator, want_key, at = False, bool(depth) and depth[-1] == "{", at + 1
            continue
        if separator and c not in b"}]":
            raise Stop
        if c in (b"}", b"]"):
            if not depth or depth.pop() != {b"}": "{", b"]": "["}[c]:
                raise Stop
            at, separator, want_key = at + 1, True, False
            yield c.decode(), None
        elif c in (b"{", b"["):
            depth.append(c.decode())
            at, want_key = at + 1, c == b"{"
            yield c.decode(), None
        elif c == b'"':
            text, at = _string(data, at + 1)
            if want_key:
                while at < len(data) and data[at] in _BLANK:
                    at += 1
                if data[at : at + 1] != b":":
                    raise Stop
                at, want_key = at + 1, False
                yield "key", text
            else:
                separator = True
                yield "string", text
        else:
            word = next((w for w in (b"true", b"false", b"null") if data.startswith(w, at)), None)
            m = None if word else _NUMBER.match(data, at)
            if not word and (not m or c not in b"-0123456789"):
                raise Stop
            at, separator = at + len(word) if word else m.end(), True
            yield "scalar", None


def events(data: bytes) -> Iterator[tuple[str, str | None]]:
    """(kind, text): ``{ } [ ]``, key, string, scalar; ends without error where the input stops making sense."""
    try:
        yield from _events(data)
    except Stop:
        return


def walk(data: bytes) -> Iterator[tuple[str, str | None, str]]:
    """("key", None, name) and ("string", key it stands under, value); arrays pass their key on."""
    outer, key = [], None
    for kind, text in events(data):
        if kind == "{":
            outer.append(key)
            key = None
        elif kind == "}":
            key = outer.pop() if outer else None
        elif kind == "key":
            key = text
            yield "key", None, text
        elif kind == "string":
            yield "string", key, text


def _skip(it: Iterator[tuple[str, str | None]]) -> bool:
    """Passes over one value; whether it was whole."""
    depth = 0
    for kind, _ in it:
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(kind, 0)
        if depth <= 0:
            return True
    return False


def object_keys(data: bytes, parent: str | None = None) -> list[str] | None:
    """Keys of the root object, or of the object under one of its keys; nothing if that isn't a whole object."""
    it = events(data)
    if next(it, ("", None))[0] != "{":
        return None
    if parent is not None:
        while True:
            kind, text = next(it, ("", None))
            if kind != "key":
                return None
            if text == parent:
                break
            if not _skip(it):
                return None
        if next(it, ("", None))[0] != "{":
            return None
    out = []
    while True:
        kind, text = next(it, ("", None))
        if kind == "}":
            return out
        if kind != "key" or not _skip(it):
            return None
        out.append(text)


def json_part(data: bytes) -> bytes:
    """From the first bracket on, or everything."""
    m = re.search(rb"[{\[]", data)
    return data[m.start() :] if m else data
