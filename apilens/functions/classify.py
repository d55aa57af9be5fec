"""What a string may be, as Column expressions (see kernels.classify for the same rules on strings)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from apilens import policy


def _any_start(s: Column, prefixes) -> Column:
    return F.regexp_like(s, F.lit("^(?:" + "|".join(map(re.escape, prefixes)) + ")"))


def _any_inside(s: Column, parts) -> Column:
    return F.regexp_like(s, F.lit("|".join(map(re.escape, parts))))


def _suffix(s: Column, extensions) -> Column:
    return F.regexp_like(s, F.lit("(?i)(?:" + "|".join(map(re.escape, extensions)) + r")\z"))


def cut(s: Column, chars: str) -> Column:
    """What stands before the first of ``chars``."""
    return F.regexp_extract(s, f"(?s)^[^{chars}]*", 0)


def has_noise(s: Column) -> Column:
    return F.regexp_like(s, F.lit(r"""[<>"' \n\r\t]|%3[cCeE]|%2[27]"""))


def _after_host(s: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(s, "^http://", ""), "^https://", "")
    return F.when(bare.contains("/"), F.regexp_replace(bare, "(?s)^[^/]*/", "")).otherwise(bare)


def only_dynamic(s: Column) -> Column:
    return F.regexp_like(_after_host(cut(s, "?")), F.lit(r"\A(?:\{dynamic\})?(?:/(?:\{dynamic\})?)*\z"))


def dynamic_suffix(s: Column) -> Column:
    return F.regexp_like(s, F.lit(r"\A(?:(?!\{dynamic\})[\s\S])*[0-9A-Za-z]\{dynamic\}"))


def _sized(s: Column) -> Column:
    return F.octet_length(s).between(2, 512)


def is_url_like(s: Column) -> Column:
    return _sized(s) & F.regexp_like(s, F.lit("^(?:/|https?://)")) & ~dynamic_suffix(s) & ~only_dynamic(s) & ~_suffix(cut(s, "?"), policy.BAD_EXT) & ~has_noise(s) & F.regexp_like(s, F.lit("[0-9A-Za-z]"))


def is_api_candidate(s: Column) -> Column:
    absolute = F.regexp_like(s, F.lit("^https?://")) & _any_inside(s, policy.API_PREFIXES)
    return is_url_like(s) & (_any_start(s, policy.API_PREFIXES) | absolute)


def is_internal(s: Column) -> Column:
    path = cut(s, "?")
    return _any_start(path, policy.INTERNAL_STARTS) | _any_inside(path, policy.INTERNAL_CONTAINS) | path.isin(*policy.INTERNAL_EXACT)


def is_source(s: Column) -> Column:
    path = cut(s, "?#")
    name = F.regexp_extract(path, "[^/]*$", 0)
    return _suffix(name, policy.SOURCE_EXT) | F.regexp_like(path, F.lit(r"(?:\.d\.ts|\.config)\z")) | _any_inside(path, policy.DEV_CONTAINS)


def is_generated(s: Column) -> Column:
    return F.regexp_like(cut(s, "?#"), F.lit(r"\A/*(?=[^/]*[_!$*+\\])[A-Za-z0-9_\-!$*+\\]{12,}/*\z"))


def is_substantive(s: Column) -> Column:
    parts = F.split(_after_host(cut(s, "?#")), "/")
    return F.exists(parts, lambda p: (p != "") & ~F.regexp_like(p, F.lit(r"\A[0-9]+\z")) & ((F.octet_length(p) >= 3) | F.regexp_like(p, F.lit("[-_]"))))


def is_client_route(s: Column) -> Column:
    like = _sized(s) & F.regexp_like(s, F.lit("^/(?!/)")) & F.regexp_like(s, F.lit("[0-9A-Za-z]")) & ~_suffix(cut(s, "?#"), policy.ROUTE_BAD_EXT) & ~has_noise(s) & ~only_dynamic(s)
    apart = _any_start(s, (*policy.API_PREFIXES, *policy.FRAMEWORK_STARTS)) | is_internal(s) | is_source(s) | is_generated(s)
    return (s == "/") | (like & ~apart & is_substantive(s))


def query_keys(s: Column) -> Column:
    """Sorted distinct keys of the query, trimmed, non-empty, of 128 bytes at most."""
    query = F.regexp_extract(s, r"(?s)^[^?]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.regexp_replace(F.regexp_extract(p, "(?s)^[^=]*", 0), r"(?U)^\s+|\s+$", ""))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: (k != "") & (F.octet_length(k) <= 128))))


def api_url(s: Column) -> Column:
    """Without fragment; without the query if that has a key."""
    bare = cut(s, "#")
    return F.when(F.size(query_keys(bare)) > 0, cut(bare, "?")).otherwise(bare)


def canonical_route(s: Column) -> Column:
    path = F.regexp_replace(cut(s, "?#"), r"/+\z", "")
    return F.when(path == "", "/").otherwise(path)
