"""URLs as Column expressions. Strings that hold ``{dynamic}`` or ``[slug]`` are parsed too, unlike by parse_url."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def with_scheme(s: Column) -> Column:
    """A typed address: https where no scheme is given; null for schemes other than http and https."""
    return F.when(~s.contains("://"), F.concat(F.lit("https://"), s)).when(F.regexp_like(s, F.lit("(?i)^https?://")), s)


def clean_path(path: Column) -> Column:
    """Without dot segments and empty segments; a trailing slash stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    popped = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", popped(acc)).otherwise(F.concat(acc, F.array(p))))
    out = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))
    return F.when(F.regexp_like(path, F.lit(r"(?:/|/\.|/\.\.)\z")) & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)


def part(s: Column, k: int) -> Column:
    """scheme, authority, path, query, fragment: 1 to 5; empty where missing."""
    return F.regexp_extract(s, _SPLIT, k)


def parsed(s: Column) -> Column:
    """struct<scheme, host, port, path, query, fragment>; null where it isn't an absolute URL."""
    scheme, authority = F.lower(part(s, 1)), F.regexp_replace(part(s, 2), r"(?s)^.*@", "")
    port = F.regexp_extract(authority, r":([0-9]+)\z", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = clean_path(part(s, 3))
    mark = lambda c, k: F.when(F.regexp_like(s, F.lit(c)), part(s, k))
    return F.when(
        F.regexp_like(s, F.lit(_SPLIT)),
        F.struct(
            scheme.alias("scheme"),
            F.lower(F.regexp_replace(authority, r":[0-9]+\z", "")).alias("host"),
            F.when((port != "") & ~default, port.cast("int")).alias("port"),
            F.when(path == "", "/").otherwise(path).alias("path"),
            mark(r"\A[^#?]*\?", 4).alias("query"),
            mark("#", 5).alias("fragment"),
        ),
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which stands in the plan once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _ascii(s: Column) -> Column:
    """What isn't ASCII percent-encoded in UTF-8."""
    runs = F.regexp_extract_all(s, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"))
    return F.array_join(F.transform(runs, lambda x: F.when(F.regexp_like(x, F.lit(r"\A[\x00-\x7F]")), x).otherwise(F.url_encode(x))), "")


def _spelt(text: Column) -> Column:
    """``absolute`` of what is ASCII."""
    sound = lambda u: F.regexp_like(u["host"], F.lit(r"\A(?:\[[0-9a-f:.]+\]|[^\x00-\x20\"#%/:<>?@\[\\\]^|\x7f]+)\z"))
    tail = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c.cast("string")), F.lit(""))
    user = F.regexp_extract(part(text, 2), r"(?s)\A.*@", 0)
    return _bound(parsed(text), lambda u: F.when(sound(u), F.concat(u["scheme"], F.lit("://"), user, u["host"], tail(":", u["port"]), u["path"], tail("?", u["query"]), tail("#", u["fragment"]))))


def absolute(s: Column) -> Column:
    """An absolute URL in one spelling: scheme and host in lower case, no default port, a clean path; null where it isn't one."""
    return _bound(_ascii(s), _spelt)


def _joined(b: Column, r: Column, rest: Column) -> Column:
    """What ``r``, with ``rest`` before its query and fragment, means at ``b``."""
    origin = F.concat(part(b, 1), F.lit("://"), part(b, 2))
    tail = F.substr(r, F.length(rest) + 1)
    query = F.when(tail.startswith("?"), "").otherwise(F.regexp_extract(b, r"(?s)\A[^?#]*(\?[^#]*)", 1))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.regexp_extract(part(b, 3), r"(?s)\A.*/", 0), rest))
    return (
        F.when(F.regexp_like(r, F.lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*:")), r)
        .when(rest.startswith("//"), F.concat(part(b, 1), F.lit(":"), r))
        .when(rest == "", F.concat(origin, part(b, 3), query, tail))
        .otherwise(F.concat(origin, path, tail))
    )


def joined(base: Column, ref: Column) -> Column:
    """``ref`` as seen from ``base``, in the spelling of ``absolute``; null where either can't be read."""
    whole = lambda b, r: _bound(F.regexp_extract(r, r"(?s)\A[^?#]*", 0), lambda rest: _joined(b, r, rest))
    return _bound(absolute(base), lambda b: F.when(b.isNotNull(), _bound(_bound(_ascii(ref), lambda r: whole(b, r)), _spelt)))


def cache_key(s: Column) -> Column:
    """Scheme, host, path without its last slash, and the query's pairs in order."""
    u = parsed(s)
    path = F.when(F.length(u["path"]) > 1, F.regexp_replace(u["path"], r"/\z", "")).otherwise(u["path"])
    pairs = F.transform(F.filter(F.split(u["query"], "&"), lambda p: p != ""), lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    query = F.when(F.size(pairs) > 0, F.array_join(F.array_sort(pairs), "&")).otherwise(u["query"])
    return F.concat(u["scheme"], F.lit("://"), u["host"], F.coalesce(F.concat(F.lit(":"), u["port"].cast("string")), F.lit("")), path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


def surface_path(s: Column) -> Column:
    """The path under which an API is listed: no host, query or last slashes; ``{dynamic}`` as ``:id``."""
    raw = F.when(F.regexp_like(s, F.lit("(?i)^https?://[^/?#]")), parsed(s)["path"]).otherwise(F.regexp_extract(s, "(?s)^[^?#]*", 0))
    bare = F.regexp_replace(raw, r"/+\z", "")
    path = F.when(bare == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.replace(path, F.lit("{dynamic}"), F.lit(":id"))


def first_segment(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)\A/?([^/]*)", 1))


def is_private_v4(host: Column) -> Column:
    """Private, loopback, link-local, broadcast, documentation, 0.x and from 224 on."""
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b, c = octets[0], octets[1], octets[2]
    shape = F.regexp_like(host, F.lit(r"\A(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|\z)){4}(?<!\.)\z"))
    documented = ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254)) | documented | (a == 0) | (a >= 224)
    return shape & F.when(shape, private).otherwise(False)


def is_local_name(host: Column) -> Column:
    return F.regexp_like(host, F.lit(r"(?i)\A(?:localhost|.*\.localhost|.*\.local)\.*\z"))


def is_allowed(s: Column, allow_private: bool = False) -> Column:
    """Whether an address may be fetched: http or https, and public unless private ones are allowed."""
    u = parsed(s)
    web = F.coalesce(u["scheme"].isin("http", "https") & (u["host"] != ""), F.lit(False))
    v6 = F.regexp_like(u["host"], F.lit(r"(?i)\A\[(?:::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f]?[0-9a-f:]*|ff[89ab][0-9a-f]?:[0-9a-f:]*)\]\z"))
    return web if allow_private else web & ~is_private_v4(u["host"]) & ~is_local_name(u["host"]) & ~v6
