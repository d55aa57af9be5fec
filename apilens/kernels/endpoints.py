"""The endpoint scan: call sites, route values, quoted paths, client wrappers."""

from __future__ import annotations

import re

from apilens import policy
from apilens.kernels import bytescan as B
from apilens.kernels import classify
from apilens.kernels.evidence import CONTENT_BIT, METHOD_BIT, Findings, Shape

_KINDS = {
    **dict.fromkeys(policy.ROUTE_STARTS, "start"),
    **dict.fromkeys(policy.ROUTE_VALUES, "value"),
    **dict.fromkeys(policy.ROUTE_CALLS, "route"),
    **dict.fromkeys(policy.API_CANDIDATES, "candidate"),
    **dict.fromkeys(policy.API_CALLS, "call"),
}
#: Leftmost, the longest at a place, without overlaps.
LITERALS = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(_KINDS, key=len, reverse=True)))
_KIND_OF = {k.encode(): v for k, v in _KINDS.items()}
_METHOD = re.compile(rb"method[ \t\n\f\r]*:?[ \t\n\f\r]*[\"'`]?([a-z]*)")
_NEAR = [(m, m.lower().encode()) for m in policy.NEAR_METHODS]
_HINTS = [x.encode() for x in policy.RECEIVER_HINTS]
_DECLARED = (b"const ", b"let ", b"var ")


def _near_method(body: B.Body, at: int) -> str | None:
    """The first method, in a fixed order, named before the next ``;`` or else within 256 bytes."""
    end = body.data.find(b";", at)
    part = body.lower[at : end if end >= 0 else at + 256]
    return next((m for m, low in _NEAR if low in part), None)


def _call_shape(data: bytes, lower: bytes, after: int, anchor: str) -> Shape:
    shape = Shape()
    verb = anchor.rstrip("(").rpartition(".")[2].upper() if "." in anchor else ""
    shape.methods = METHOD_BIT.get(verb, 0)
    fetch = anchor.startswith("fetch")
    if not fetch and verb not in ("POST", "PUT", "PATCH"):
        return shape
    end = B.argument_end(data, after)
    if end is None:
        return shape
    at = B.after_blanks(data, end)
    if data[at : at + 1] != b",":
        return shape
    at = B.after_blanks(data, at + 1)
    opens = data[at : at + 1] == b"{"
    if not fetch:
        if at < len(data) and data[at] != 0x29:
            shape.has_body = True
            shape.content_types |= CONTENT_BIT["json"] if opens else 0
    elif opens and (end := B.bracket_end(data, at)) is not None:
        options = lower[at : end + 1]
        has = lambda hints: any(h.encode() in options for h in hints)
        for m in _METHOD.finditer(options):
            shape.methods |= METHOD_BIT.get(m[1].decode().upper(), 0)
        shape.has_body, shape.has_headers, shape.auth = has(policy.BODY_HINTS), has(policy.HEADER_HINTS), has(policy.AUTH_HINTS)
        for name, hints in policy.CONTENT_HINTS.items():
            shape.content_types |= CONTENT_BIT[name] if has(hints) else 0
    return shape


def _template(data: bytes, at: int, known: dict[bytes, str]) -> str:
    """A template's content; a slot that is a known name alone gives its value, another ``{dynamic}``."""
    out, start, lone = [], at, re.compile(rb"(?s)\\(.)|\$\{|`")
    while m := lone.search(data, at):
        out.append(data[start : m.start()])
        if m[1] is not None:
            out.append(m[1])
            start = at = m.end()
        elif m[0] == b"`":
            return b"".join(out).decode("utf-8", "replace")
        else:
            start = at = B.after_slot(data, m.end())
            name = data[m.end() : max(m.end(), at - 1)].strip(B.BLANK)
            out.append(known[name].encode() if name in known and B.name_at(name, 0) == name else B.DYNAMIC)
    return b"".join([*out, data[start:]]).decode("utf-8", "replace")


def _static(data: bytes, at: int, known: dict[bytes, str]) -> tuple[str, int] | None:
    """Strings and known names joined by ``+``, and the place behind them."""
    out = []
    while (at := B.after_blanks(data, at)) < len(data):
        if B.is_quote(data, at):
            quote = data[at]
            part = _template(data, at + 1, known) if quote == 0x60 else B.string_from(data, at + 1, quote, False)
            end = B.quote_end(data, at + 1, quote)
            if part is None or end is None:
                return None
            out.append(part)
            at = end + 1
        elif (name := B.name_at(data, at)) is not None:
            if name not in known:
                return None
            out.append(known[name])
            at += len(name)
        elif 0x30 <= data[at] <= 0x39:
            return None
        else:
            break
        at = B.after_blanks(data, at)
        if data[at : at + 1] != b"+":
            break
        at += 1
    else:
        return None
    found = "".join(out)
    return (found, at) if out and not found.startswith("{dynamic}") else None


def string_bindings(data: bytes) -> dict[bytes, str]:
    """Names declared with a URL-like static string: all const, then let, then var; later ones win."""
    known: dict[bytes, str] = {}
    for keyword in _DECLARED:
        for at in B.places(data, keyword):
            at += len(keyword)
            end = at + 2048
            while at < min(end, len(data)):
                at = B.after_blanks(data, at)
                name = B.name_at(data, at)
                if name is None:
                    break
                at = B.after_blanks(data, at + len(name))
                found = _static(data, B.after_blanks(data, at + 1), known) if data[at : at + 1] == b"=" else None
                if found is None:
                    break
                if classify.is_url_like(found[0]):
                    known[name] = found[0]
                at = B.after_blanks(data, found[1])
                if data[at : at + 1] != b",":
                    break
                at += 1
    return known


def _object_value(data: bytes, keys: tuple[bytes, ...], found) -> str | None:
    """The first value that ``found`` makes of what follows ``key:``, key by key."""
    for key in keys:
        at = data.find(key)
        while at >= 0:
            if B.starts_name(data, at):
                i = B.after_blanks(data, at + len(key))
                if data[i : i + 1] == b":" and (value := found(B.after_blanks(data, i + 1))) is not None:
                    return value
            at = data.find(key, at + 1)
    return None


def _has_key(data: bytes, key: bytes) -> bool:
    return bool(re.search(rb"(?<![A-Za-z0-9_$])" + key, data))


def _object_call(body: B.Body, after: int, known: dict[bytes, str], out: Findings) -> None:
    data = body.data
    at = B.after_blanks(data, after)
    if data[at : at + 1] != b"{":
        return
    end = B.bracket_end(data, at)
    part = data[at : at + 1024 if end is None else end + 1]
    quoted = lambda i: B.url_argument(part, i) if B.is_quote(part, i) else None
    static = lambda i: (_static(part, i, known) or (None,))[0]
    keys = (b"url", b"URL", b"endpoint", b"path")
    url = _object_value(part, keys, quoted)
    url = _object_value(part, keys, static) if url is None else url
    if url is not None:
        method = _object_value(part, (b"method",), quoted) or _near_method(body, at)
        out.api(url, Shape.inferred(method, _has_key(part, b"data") or _has_key(part, b"body")), "api_client")


def _clients(body: B.Body, out: Findings) -> None:
    data, known = body.data, None
    for anchor, method, mode in policy.client_anchors():
        needle = anchor.encode()
        for at in B.places(data, needle):
            known = string_bindings(data) if known is None else known
            after = at + len(needle)
            if mode == "object":
                _object_call(body, after, known, out)
                continue
            if mode == "generic_method" and not any(h in data[max(0, at - 64) : at] for h in _HINTS):
                continue
            url = B.url_argument(data, after)
            if url is None:
                url = (_static(data, after, known) or (None,))[0]
            if url is not None:
                near = method if mode == "generic_method" or method else _near_method(body, after)
                out.api(url, Shape.inferred(near), "api_client")


def scan_endpoints(data: bytes, out: Findings | None = None) -> Findings:
    """All evidence of one document's bytes."""
    out = Findings() if out is None else out
    body = B.Body(data)
    for m in LITERALS.finditer(data):
        kind, at, after = _KIND_OF[m[0]], m.start(), m.end()
        if kind == "call":
            url = B.url_argument(data, after)
            if url is not None:
                shape = _call_shape(data, body.lower, after, m[0].decode())
                shape.methods = shape.methods or METHOD_BIT["GET"]
                out.api(url, shape, "api_call")
        elif kind == "route":
            if (url := B.url_argument(data, after)) is not None:
                out.route(url, "route_call")
        elif kind == "value":
            if B.starts_name(data, at) and (url := B.assigned_value(data, after)) is not None:
                out.route(url, "literal")
        else:
            slash = after - 1 if kind == "start" else at
            url = B.token_from(data, body.token_start(slash), True)
            if not (url is not None and out.candidate(url)) and kind == "start":
                if (url := B.token_from(data, slash, True)) is not None:
                    out.route(url, "literal")
    _clients(body, out)
    return out
