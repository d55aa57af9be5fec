"""Parsing and joining URLs as the scanner understands them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import quote

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*")
_BAD_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^|\x7f]")
_DEFAULT_PORTS = {"http": 80, "https": 443}


class BadUrl(ValueError):
    """Not a URL."""


def clean_path(path: str) -> str:
    """Without dot segments and empty segments; a trailing slash stays."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    found = ("/" if path.startswith("/") else "") + "/".join(out)
    if path.endswith(("/", "/.", "/..")) and not found.endswith("/"):
        found += "/"
    return found


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str | None
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            out += "//" + (f"{self.user}@" if self.user is not None else "") + (f"[{self.host}]" if ":" in self.host else self.host) + (f":{self.port}" if self.port is not None else "")
        return out + self.path + (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")

    def join(self, ref: str) -> Url:
        if has_scheme(ref):
            return parse(ref)
        rest, _, fragment = ref.partition("#")
        rest, mark, query = rest.partition("?")
        tail = (f"?{query}" if mark else "") + (f"#{fragment}" if "#" in ref else "")
        if rest.startswith("//"):
            return parse(f"{self.scheme}:{rest}{tail}")
        if not rest:
            path = self.path
            if not mark and self.query is not None:
                tail = f"?{self.query}" + tail
        else:
            path = clean_path(rest if rest.startswith("/") else self.path[: self.path.rfind("/") + 1] + rest)
        return parse(str(replace(self, path=path or "/", query=None, fragment=None)) + tail)


def has_scheme(text: str) -> bool:
    head, mark, _ = text.partition(":")
    return bool(mark) and bool(_SCHEME.fullmatch(head))


@lru_cache(maxsize=4096)
def parse(text: str) -> Url:
    """Scheme and host in lower case, default ports dropped, the path cleaned, non-ASCII percent-encoded."""
    text = re.sub(r"[^\x00-\x7f]+", lambda m: quote(m[0]), text)
    head, mark, rest = text.partition(":")
    if not mark or not _SCHEME.fullmatch(head):
        raise BadUrl(text)
    scheme = head.lower()
    rest, mark, fragment = rest.partition("#")
    fragment = fragment if mark else None
    rest, mark, query = rest.partition("?")
    query = query if mark else None
    user = host = port = None
    if rest.startswith("//"):
        authority, slash, path = rest[2:].partition("/")
        path = clean_path(slash + path) or "/"
        user, at, hostport = authority.rpartition("@")
        user = user if at else None
        host, port = _host_port(hostport)
        if not host and scheme in _DEFAULT_PORTS:
            raise BadUrl(text)
        port = None if port == _DEFAULT_PORTS.get(scheme) else port
    elif scheme in _DEFAULT_PORTS:
        raise BadUrl(text)
    else:
        path = rest
    return Url(scheme, user, host, port, path, query, fragment)


def _host_port(text: str) -> tuple[str, int | None]:
    if text.startswith("["):
        host, mark, after = text[1:].partition("]")
        if not mark or (after and not re.fullmatch(r":\d+", after)) or not re.fullmatch(r"[0-9A-Fa-f:.]+", host):
            raise BadUrl(text)
        port = after[1:]
    else:
        host, mark, port = text.rpartition(":")
        if text.count(":") != 1 or not re.fullmatch(r"[0-9]+", port):
            host, port = text, ""
        if _BAD_HOST.search(host):
            raise BadUrl(text)
    number = int(port) if port else None
    if number is not None and number > 65535:
        raise BadUrl(text)
    return host.lower(), number


def try_parse(text: str) -> Url | None:
    try:
        return parse(text)
    except BadUrl:
        return None


def try_join(base: Url, ref: str) -> Url | None:
    try:
        return base.join(ref)
    except BadUrl:
        return None


def query_keys(query: str | None) -> list[str]:
    return [pair.partition("=")[0] for pair in (query or "").split("&") if pair]


def join_paths(left: str, right: str) -> str:
    left, right = left.rstrip("/"), right.lstrip("/")
    return f"{left}/{right}" if left and right else left or f"/{right}"
