"""Schemas of the engine's tables."""

from __future__ import annotations

DOCUMENTS = "site_id string, url string, kind string, body binary"
SHAPE = "struct<methods: int, has_body: boolean, has_headers: boolean, content_types: int, auth: boolean, next_server_action: boolean, query_params: array<string>>"
EVIDENCE = f"url string, kind string, channel string, framework string, shape {SHAPE}"
ASSET = "url string, kind string, source string"
SITE = "struct<active: array<string>, primary: string, label: string, revision: string>"
#: One row per finding of a document, tagged: evidence, asset or site.
SCANNED = f"site_id string, doc_url string, seq int, tag string, url string, kind string, channel string, framework string, shape {SHAPE}, source string, site {SITE}"
KINDS = ("api", "route", "candidate")
