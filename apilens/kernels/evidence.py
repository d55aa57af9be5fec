"""Rows that a scan gives: evidence with its shape, assets, the site."""

from __future__ import annotations

from dataclasses import dataclass, field

from apilens import policy
from apilens.kernels import classify

METHOD_BIT = {m: 1 << i for i, m in enumerate(policy.METHODS)}
CONTENT_BIT = {c: 1 << i for i, c in enumerate(policy.CONTENT_TYPES)}


@dataclass
class Shape:
    methods: int = 0
    has_body: bool = False
    has_headers: bool = False
    content_types: int = 0
    auth: bool = False
    next_server_action: bool = False
    query_params: list[str] = field(default_factory=list)

    @classmethod
    def inferred(cls, method: str | None, has_body: bool = False) -> Shape:
        return cls(METHOD_BIT.get((method or "GET").upper(), 0) or METHOD_BIT["GET"], has_body)


class Findings:
    """Evidence in the order it was found: (url, kind, channel, framework, shape)."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str, str | None, Shape | None]] = []

    def record(self, url: str, kind: str, channel: str, framework: str | None = None, shape: Shape | None = None) -> None:
        self.rows.append((url, kind, channel, framework, shape))

    def api(self, url: str, shape: Shape, channel: str) -> None:
        """An API if the string can be one; the query's keys go to the shape."""
        if classify.is_url_like(url):
            shape.query_params = sorted({*shape.query_params, *classify.query_keys(url)}, key=str.encode)
            self.record(classify.api_url(url), "api", channel, None, shape)

    def route(self, url: str, channel: str) -> None:
        if classify.is_client_route(url):
            self.record(url, "route", channel)

    def candidate(self, url: str, channel: str = "literal") -> bool:
        if not classify.is_api_candidate(url):
            return False
        self.record(classify.api_url(url), "candidate", channel)
        return True
