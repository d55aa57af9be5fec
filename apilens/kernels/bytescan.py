"""Quotes, tokens, brackets and keyed fields in raw bytes."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np

DYNAMIC = b"{dynamic}"
BLANK = b" \t\n\f\r"
QUOTES = b"\"'`"
_STOPS = rb"\s\"'`<>()\[\]{},;".replace(rb"\s", rb" \t\n\f\r")
STOP = re.compile(b"[" + _STOPS + b"=]")
STOP_BUT_EQUALS = re.compile(b"[" + _STOPS + b"]")
_REPLACING = re.compile(rb"\{dynamic\}|\$\{|[" + _STOPS + b"=]")
_BRACE = re.compile(rb"(?s)\\.|[{}]")
_BRACKET = re.compile(rb"[\"'`{}()\[\]]")
_BLANKS = re.compile(b"[" + BLANK + b"]*")
_NAME = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$]*")
_END = {q: re.compile(rb"(?s)(?:[^\\Q]|\\.)*+Q".replace(b"Q", bytes([q]))) for q in QUOTES}
_PART = {q: re.compile(rb"(?s)\\(.)|\$\{|Q".replace(b"Q", bytes([q]))) for q in QUOTES}
_NAME_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$")


def text_of(raw: bytes) -> str | None:
    """As text without outer backslashes; nothing where it isn't UTF-8."""
    try:
        return raw.decode().strip("\\")
    except UnicodeDecodeError:
        return None


def after_blanks(data: bytes, at: int) -> int:
    return _BLANKS.match(data, at).end()


def is_quote(data: bytes, at: int) -> bool:
    return at < len(data) and data[at] in QUOTES


def name_at(data: bytes, at: int) -> bytes | None:
    m = _NAME.match(data, at)
    return m[0] if m else None


def starts_name(data: bytes, at: int) -> bool:
    """Whether no name runs into ``at`` from the left."""
    return at == 0 or data[at - 1] not in _NAME_BYTES


def is_name(data: bytes, at: int, size: int) -> bool:
    return starts_name(data, at) and (at + size >= len(data) or data[at + size] not in _NAME_BYTES)


def after_slot(data: bytes, at: int) -> int:
    """The place after the brace that closes a template slot opened just before ``at``."""
    depth = 1
    for m in _BRACE.finditer(data, at):
        depth += {b"{": 1, b"}": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(data)


def quote_end(data: bytes, at: int, quote: int) -> int | None:
    """The closing quote of a string whose content begins at ``at``."""
    m = _END[quote].match(data, at)
    return m.end() - 1 if m else None


def string_from(data: bytes, at: int, quote: int, slots: bool) -> str | None:
    """A string's content, escapes undone; to the end where it isn't closed.

    With ``slots``, those of a template are replaced by ``{dynamic}``.
    """
    out, start = [], at
    while m := _PART[quote].search(data, at):
        if m[1] is not None:
            out += [data[start : m.start()], m[1]]
            start = at = m.end()
        elif m[0] == b"${":
            if slots and quote == 0x60:
                out += [data[start : m.start()], DYNAMIC]
                start = at = after_slot(data, m.end())
            else:
                at = m.start() + 1
        else:
            return text_of(b"".join([*out, data[start : m.start()]]))
    return text_of(b"".join([*out, data[start:]]))


def string_at(data: bytes, at: int, slots: bool = False) -> str | None:
    return string_from(data, at + 1, data[at], slots) if is_quote(data, at) else None


def raw_argument(data: bytes, at: int) -> str | None:
    """A closed string argument as it stands."""
    at = after_blanks(data, at)
    if not is_quote(data, at) or (end := quote_end(data, at + 1, data[at])) is None:
        return None
    try:
        return data[at + 1 : end].decode()
    except UnicodeDecodeError:
        return None


def argument_end(data: bytes, at: int) -> int | None:
    """The place after a string argument, template slots and escapes passed over."""
    at = after_blanks(data, at)
    if not is_quote(data, at):
        return None
    quote, at = data[at], at + 1
    while m := _PART[quote].search(data, at):
        if m[1] is not None:
            at = m.end()
        elif m[0] == b"${":
            at = after_slot(data, m.end()) if quote == 0x60 else m.start() + 1
        else:
            return m.end()
    return len(data)


def bracket_end(data: bytes, at: int) -> int | None:
    """The bracket that closes the one at ``at``; strings are passed over, kinds aren't matched."""
    depth = 0
    while m := _BRACKET.search(data, at):
        c = m[0][0]
        if c in QUOTES:
            end = quote_end(data, m.end(), c)
            if end is None:
                return None
            at = end + 1
            continue
        depth += 1 if c in b"{[(" else -1
        if depth <= 0:
            return m.start() if depth == 0 else None
        at = m.end()
    return None


def url_argument(data: bytes, at: int) -> str | None:
    """A string argument at ``at``, or the string whose opening quote is just before it."""
    if at > 0 and data[at - 1] in QUOTES:
        found = string_from(data, at, data[at - 1], True)
    else:
        at = after_blanks(data, at)
        found = string_at(data, at, True)
    return None if found is None or found.startswith("{dynamic}") else found


def assigned_value(data: bytes, at: int) -> str | None:
    """The string after a key that ends at ``at``, with ``:`` or ``=`` between; the key may be quoted."""
    at = after_blanks(data, at)
    if is_quote(data, at):
        quote, at = data[at], after_blanks(data, at + 1)
        at += at < len(data) and data[at] == quote
    at = after_blanks(data, at)
    return url_argument(data, at + 1) if data[at : at + 1] in (b":", b"=") else None


def token_from(data: bytes, at: int, slots: bool) -> str | None:
    """From ``at`` to the next delimiter. With ``slots``, template slots count as part, replaced."""
    if not slots:
        m = STOP.search(data, at)
        return text_of(data[at : m.start() if m else len(data)])
    out, start = [], at
    while m := _REPLACING.search(data, at):
        if m[0] == b"${":
            out += [data[start : m.start()], DYNAMIC]
            start = at = after_slot(data, m.end())
        elif m[0] == DYNAMIC:
            at = m.end()
        else:
            return text_of(b"".join([*out, data[start : m.start()]]))
    return text_of(b"".join([*out, data[start:]]))


def asset_token(data: bytes, at: int) -> str | None:
    """A token; with a query it is cut anew without taking ``=`` for a delimiter."""
    found = token_from(data, at, False)
    if found is None or ("?" not in found and "&" not in found):
        return found
    m = STOP_BUT_EQUALS.search(data, at)
    return text_of(data[at : m.start() if m else len(data)])


def places(data: bytes, needle: bytes) -> Iterator[int]:
    """Where ``needle`` stands, without overlaps."""
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + len(needle))


class Body:
    """A document's bytes with an index of its delimiters, so that a token's start is found at once."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def _stops(self) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(b" \t\n\f\r\"'`<>()[]{},;=")] = True
        return np.flatnonzero(table[np.frombuffer(self.data, np.uint8)])

    @cached_property
    def lower(self) -> bytes:
        return self.data.lower()

    def token_start(self, at: int) -> int:
        k = bisect_left(self._stops, at)
        return int(self._stops[k - 1]) + 1 if k else 0

    def quoted_tokens(self, marker: bytes) -> Iterator[tuple[int, int]]:
        """(marker's place, token's start) where the token follows a quote."""
        for at in places(self.data, marker):
            start = self.token_start(at)
            if start > 0 and self.data[start - 1] in QUOTES:
                yield at, start

    def has(self, *needles: str) -> bool:
        return any(n.encode() in self.data for n in needles)


def quoted_after(data: bytes, markers) -> Iterator[str]:
    """Tokens that follow a quote and hold a marker, marker by marker."""
    body = Body(data)
    for marker in markers:
        for _, start in body.quoted_tokens(marker.encode()):
            if (found := token_from(data, start, False)) is not None:
                yield found


def quoted_strings(data: bytes, slots: bool) -> Iterator[str]:
    """All strings from quote to quote; after one that isn't closed the walk goes on behind its quote."""
    at, pattern = 0, re.compile(b"[\"'`]")
    while m := pattern.search(data, at):
        quote = m[0][0]
        if (found := string_from(data, m.end(), quote, slots)) is not None:
            yield found
        end = quote_end(data, m.end(), quote)
        at = m.end() if end is None else end + 1


def keyed(data: bytes, key: bytes, separators: bytes, quoted_key: bool, start: int = 0) -> Iterator[int]:
    """Where the values of ``key`` begin: a whole name, then a separator."""
    for at in places(data[start:] if start else data, key):
        at += start
        if not is_name(data, at, len(key)):
            continue
        i = after_blanks(data, at + len(key))
        if data[i : i + 1] in (b'"', b"'"):
            if not quoted_key:
                continue
            quote, i = data[i], after_blanks(data, i + 1)
            if i < len(data) and data[i] == quote:
                i = after_blanks(data, i + 1)
        if i < len(data) and data[i] in separators:
            yield after_blanks(data, i + 1)


def field(data: bytes, key: str, separators: bytes = b":", quoted_key: bool = True, start: int = 0) -> str | None:
    """The string value at the first place where ``key`` has a value, whatever that is."""
    at = next(keyed(data, key.encode(), separators, quoted_key, start), None)
    return None if at is None else string_at(data, at)


def key_places(data: bytes, keys) -> Iterator[tuple[int, str]]:
    """Places of whole-name keys, key by key."""
    for key in keys:
        for at in places(data, key.encode()):
            if is_name(data, at, len(key)):
                yield at, key
