"""Typing of asset URLs, detection of frameworks, and app routes, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from apilens import policy


def _ends(s: Column, *suffixes: str) -> Column:
    return F.regexp_like(s, F.lit("(?i)(?:" + "|".join(map(re.escape, suffixes)) + r")\z"))


def _inside(s: Column, parts) -> Column:
    return F.regexp_like(s, F.lit("|".join(map(re.escape, parts))))


def _path(raw: Column) -> Column:
    return F.regexp_extract(raw, "(?s)^[^?#]*", 0)


def is_manifest(raw: Column) -> Column:
    path = _path(raw)
    named = _ends(path, *policy.NEXT_ARTIFACTS, "client-reference-manifest.json", "/_nuxt/manifest.json", "/_nuxt/prerendered.json", "/_app/version.json", "/manifest.js", "/manifest.json")
    return named | (path.contains("/_nuxt/builds/") & _ends(path, ".json")) | (path.contains("/immutable/") & _ends(path, "/version.json"))


def is_payload(raw: Column) -> Column:
    path = _path(raw)
    data = raw.startswith("/_next/data/") | path.contains("/_next/data/")
    rsc = F.regexp_like(F.regexp_extract(path, "[^/]*$", 0), F.lit(r"(?i)\A[A-Za-z0-9_-]{2,}(?:\.[A-Za-z0-9_.-]*)?\.rsc\z"))
    return (
        (_ends(path, ".json") & data)
        | rsc
        | _ends(path, "_payload.json", "/__data.json")
        | _inside(raw, ("?_rsc=", "&_rsc=", "/_payload.json?", "/__data.json?", "/_actions/", "?_data=", "&_data="))
        | _inside(path, ("/__nuxt_island/", "/_server-islands/", "/_data/"))
    )


def asset_kind(raw: Column) -> Column:
    """manifest, payload, script or null."""
    return F.when(is_manifest(raw), "manifest").when(is_payload(raw), "payload").when(_ends(_path(raw), ".js", ".mjs"), "script")


def is_skipped(path: Column) -> Column:
    mounts = (("/_next/", policy.NEXT_SKIP), ("/_nuxt/", policy.NUXT_SKIP), ("/immutable/", policy.SVELTE_SKIP), ("/_astro/", policy.ASTRO_SKIP))
    out = _inside(path, policy.REMIX_SKIP)
    for mount, fragments in mounts:
        out = out | (path.contains(mount) & _inside(path, fragments))
    return out


def is_low_signal(kind: Column, path: Column) -> Column:
    return (kind == "script") & _inside(path, policy.LOW_SIGNAL)


def priority(kind: Column, source: Column, path: Column) -> Column:
    """The order in which a crawl takes assets; smaller first."""
    return (
        F.when(source.isin("next_manifest", "framework_manifest"), 0)
        .when(kind == "manifest", 1)
        .when(source.isin("html_script", "html_preload") & (kind == "script"), 2)
        .when(kind == "payload", 3)
        .when(source.isin("dynamic_import", "new_url"), 4)
        .when(_inside(path, ("app", "page")), 5)
        .when(_inside(path, policy.LOW_SIGNAL), 8)
        .otherwise(6)
    )


def detected(body: Column, path: Column) -> Column:
    """array<string> of the frameworks in use, in order of precedence."""
    by_path = {"next": ("/_next/",), "nuxt": ("/_nuxt/",), "sveltekit": ("/immutable/",), "astro": ("/_astro/", "/_actions/"), "remix": ("/build/",)}
    found = [F.when(_inside(body, policy.CONTEXTS[f]) | (_inside(path, by_path[f]) if f in by_path else F.lit(False)), F.lit(f)) for f in policy.FRAMEWORKS]
    return F.array_compact(F.array(*found))


def app_route(raw: Column) -> Column:
    """An app directory's path as a route: groups and slots out, intercepting marks cut."""
    parts = F.transform(F.split(raw, "/"), lambda p: F.when(F.regexp_like(p, F.lit(r"\A\(\.{1,3}\)")), F.regexp_replace(p, r"\A\(\.{1,3}\)", "")).when(F.regexp_like(p, F.lit(r"\A(?:@.*|\(.*\))\z")), F.lit("")).otherwise(p))
    kept = F.filter(parts, lambda p: p != "")
    return F.when(~F.regexp_like(raw, F.lit("[(@]")), raw).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def needs_rsc(url: Column) -> Column:
    return F.regexp_like(_path(url), F.lit(r"\.rsc\z")) | F.regexp_like(url, F.lit(r"(?i)\A[^#]*[?&]_rsc(?:[=&#]|\z)"))
