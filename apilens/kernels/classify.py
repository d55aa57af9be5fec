"""What a string found in a document may be: URL-like, API candidate, client route.

The same rules as Column expressions are in ``apilens.functions.classify``; a
test holds the two against each other.
"""

from __future__ import annotations

import re

from apilens import policy

_CUT = re.compile(r"[?#]")
_NOISE = re.compile(r"[<>\"' \n\r\t]|%3[cCeE]|%2[27]")
_ALNUM = re.compile(r"[0-9A-Za-z]")
_GENERATED = re.compile(r"[A-Za-z0-9_\-!$*+\\]{12,}")
_ODD = re.compile(r"[_!$*+\\]")
_ABSOLUTE = ("http://", "https://")


def ext_pattern(extensions: tuple[str, ...]) -> str:
    """A suffix of any of ``extensions``, ASCII case ignored."""
    return "(?i)(?:" + "|".join(re.escape(e) for e in extensions) + r")\Z"


_BAD, _ROUTE_BAD, _SOURCE = (re.compile(ext_pattern(e), re.ASCII) for e in (policy.BAD_EXT, policy.ROUTE_BAD_EXT, policy.SOURCE_EXT))


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _after_host(text: str) -> str:
    """Without scheme and without what stands before the first slash."""
    text = text.removeprefix("http://").removeprefix("https://")
    head, slash, rest = text.partition("/")
    return rest if slash else head


def only_dynamic(text: str) -> bool:
    return all(s in ("", "{dynamic}") for s in _after_host(text.partition("?")[0]).split("/"))


def dynamic_suffix(text: str) -> bool:
    """Whether the first ``{dynamic}`` continues a name."""
    at = text.find("{dynamic}")
    return at > 0 and bool(_ALNUM.match(text[at - 1]))


def is_url_like(text: str) -> bool:
    return (
        2 <= _size(text) <= 512
        and text.startswith(("/", *_ABSOLUTE))
        and not dynamic_suffix(text)
        and not only_dynamic(text)
        and not _BAD.search(text.partition("?")[0])
        and not _NOISE.search(text)
        and bool(_ALNUM.search(text))
    )


def is_api_candidate(text: str) -> bool:
    inside = text.startswith(_ABSOLUTE) and any(p in text for p in policy.API_PREFIXES)
    return (inside or text.startswith(policy.API_PREFIXES)) and is_url_like(text)


def _internal(text: str) -> bool:
    path = text.partition("?")[0]
    return path in policy.INTERNAL_EXACT or path.startswith(policy.INTERNAL_STARTS) or any(x in path for x in policy.INTERNAL_CONTAINS)


def _source(path: str) -> bool:
    return bool(_SOURCE.search(path.rpartition("/")[2])) or path.endswith(policy.DEV_ENDS) or any(x in path for x in policy.DEV_CONTAINS)


def _generated(path: str) -> bool:
    parts = [s for s in path.split("/") if s]
    if len(parts) != 1 or "{dynamic}" in parts[0] or ":" in parts[0]:
        return False
    return bool(_GENERATED.fullmatch(parts[0])) and bool(_ODD.search(parts[0]))


def _substantive(path: str) -> bool:
    for part in _after_host(path).split("/"):
        if part and not re.fullmatch("[0-9]+", part) and (_size(part) >= 3 or "-" in part or "_" in part):
            return True
    return False


def is_client_route(text: str) -> bool:
    if text == "/":
        return True
    if not text.startswith("/") or text.startswith("//") or not 2 <= _size(text) <= 512:
        return False
    path = _CUT.split(text, maxsplit=1)[0]
    return not (
        text.startswith((*policy.API_PREFIXES, *policy.FRAMEWORK_STARTS))
        or not _ALNUM.search(text)
        or _ROUTE_BAD.search(path)
        or _NOISE.search(text)
        or only_dynamic(text)
        or _internal(text)
        or _source(path)
        or _generated(path)
        or not _substantive(path)
    )


def query_keys(text: str) -> list[str]:
    """Keys of the query between ``?`` and ``#``, trimmed; the empty and those over 128 bytes left out."""
    _, mark, query = text.partition("?")
    keys = (pair.partition("=")[0].strip() for pair in query.partition("#")[0].split("&")) if mark else ()
    return sorted({k for k in keys if k and _size(k) <= 128}, key=str.encode)


def api_url(text: str) -> str:
    """Without fragment, and without the query if that has a key."""
    text = text.partition("#")[0]
    return text.partition("?")[0] if query_keys(text) else text
