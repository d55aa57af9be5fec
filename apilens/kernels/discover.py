"""One document: configuration, site, revision, findings and the assets that it refers to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from apilens import policy
from apilens.kernels import bytescan as B
from apilens.kernels import frameworks as W
from apilens.kernels import urlx
from apilens.kernels.endpoints import LITERALS, scan_endpoints
from apilens.kernels.evidence import Findings
from apilens.kernels.urlx import Url

ASSETS = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(policy.ASSET_LITERALS, key=len, reverse=True)))
_DYNAMIC = ((re.compile(rb"import\("), "dynamic_import"), (re.compile(rb"new URL\("), "new_url"))
_RELS = {"preload", "modulepreload", "prefetch"}


@dataclass
class DocumentScan:
    findings: Findings = field(default_factory=Findings)
    assets: list[tuple[str, str, str]] = field(default_factory=list)  # (url, kind, source)
    revision: str | None = None
    site: W.Site = field(default_factory=W.Site)


def is_empty_script(body: B.Body, kind: str) -> bool:
    """A script without anything that a scan could find."""
    return kind == "script" and not (LITERALS.search(body.data) or ASSETS.search(body.data) or body.has("import(", "new URL(", *policy.DATA_MARKERS, *policy.CONTEXT_MARKERS))


def _tags(body: B.Body, name: bytes):
    """Tags from ``<name`` to the next ``>``, case ignored."""
    at = body.lower.find(b"<" + name)
    while at >= 0:
        end = body.data.find(b">", at)
        if end < 0:
            return
        yield body.data[at : end + 1]
        at = body.lower.find(b"<" + name, at + 1)


def attribute(tag: bytes, name: str) -> str | None:
    """The value of the first attribute so named; quoted or bare."""
    m = re.search(rb"(?is)(?<![^ \t\n\f\r</\"'])" + re.escape(name.encode()) + rb"[ \t\n\f\r]*=[ \t\n\f\r]*(.)", tag)
    if not m:
        return None
    at = m.start(1)
    if m[1] in (b'"', b"'"):
        end = tag.find(m[1], at + 1)
        raw = tag[at + 1 : end] if end >= 0 else None
    else:
        raw = re.match(rb"[^ \t\n\f\r>]*", tag[at:])[0]
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def scan_document(data: bytes, url: str | Url, kind: str, parent: W.NextConfig | None = None) -> DocumentScan:
    """Scans a document of kind html, script, manifest or payload under its URL."""
    base = urlx.parse(url) if isinstance(url, str) else url
    body, out, seen = B.Body(data), DocumentScan(), set()
    if is_empty_script(body, kind):
        return out
    config = (W.next_page_config(body) if kind == "html" else None) or parent
    out.site = site = W.detect(body, base, config)
    out.revision = W.next_revision(body, site.has("next"), config)
    scan_endpoints(data, out.findings)

    def insert(found: Url | None, asset_kind: str, source: str) -> None:
        if found is not None and found not in seen:
            seen.add(found)
            out.assets.append((str(found), asset_kind, source))

    def push(raw: str, source: str, at: Url = base) -> None:
        asset_kind = W.asset_kind(raw)
        found = W.resolve(at, raw, site) if asset_kind else None
        if found is not None and not W.skipped(found.path):
            insert(found, asset_kind, source)

    def candidate(raw: str) -> None:
        if W.is_framework_data(raw) and len(raw.encode()) <= 512:
            out.findings.record(raw, "candidate", "literal")
        if W.is_payload(raw):
            out.findings.candidate(raw)

    for marker in policy.DATA_MARKERS:
        for _, start in body.quoted_tokens(marker.encode()):
            if (raw := B.asset_token(data, start)) is not None:
                candidate(raw)
    W.scan(body, base, kind, site, config, out.findings, insert)
    if kind == "html":
        at = base
        for tag in _tags(body, b"base"):
            href = attribute(tag, "href")
            if href is not None and (found := urlx.try_join(base, href)) is not None:
                at = found
                break
        for tag in _tags(body, b"script"):
            if (src := attribute(tag, "src")) is not None:
                push(src, "html_script", at)
        for tag in _tags(body, b"link"):
            if (href := attribute(tag, "href")) is not None and _RELS & set((attribute(tag, "rel") or "").lower().split()):
                push(href, "html_preload", at)
        for tag in _tags(body, b"astro-island"):
            for name in ("component-url", "renderer-url"):
                if (raw := attribute(tag, name)) is not None:
                    push(raw, "html_preload", at)
    for m in ASSETS.finditer(data):
        start = body.token_start(m.start())
        if start > 0 and data[start - 1] in B.QUOTES and (raw := B.asset_token(data, start)) is not None:
            if raw.startswith("/_next/data/"):
                candidate(raw)
            push(raw, "literal")
    for pattern, source in _DYNAMIC:
        for m in pattern.finditer(data):
            if (raw := B.raw_argument(data, m.end())) is not None:
                push(raw, source)
    return out
