"""Shapes of API calls: their text and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from apilens import policy


def _named(mask: Column, names) -> list[Column]:
    return [F.when(mask.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)]


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws(",", *parts)


def methods_csv(shape: Column) -> Column:
    return _joined(_named(shape["methods"], policy.METHODS))


def flags_csv(shape: Column) -> Column:
    flag = lambda name, label: F.when(shape[name], F.lit(label))
    return _joined([
        flag("has_body", "body"), flag("has_headers", "headers"), *_named(shape["content_types"], policy.CONTENT_TYPES),
        flag("auth", "auth"), F.when(F.size(shape["query_params"]) > 0, "query"), flag("next_server_action", "next-action"),
    ])


def merged(shape: Column) -> Column:
    """Aggregate: masks and flags or-ed, query keys united; partial and final sides both apply."""
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(shape["query_params"]))))
    return F.when(F.count(shape) > 0, F.struct(
        F.bit_or(shape["methods"]).alias("methods"), F.bool_or(shape["has_body"]).alias("has_body"), F.bool_or(shape["has_headers"]).alias("has_headers"), F.bit_or(shape["content_types"]).alias("content_types"),
        F.bool_or(shape["auth"]).alias("auth"), F.bool_or(shape["next_server_action"]).alias("next_server_action"), keys.alias("query_params"),
    ))


def short_methods(csv: Column) -> Column:
    """DEL, PAT and OPT for the long ones, separated by spaces."""
    short = {"DELETE": "DEL", "PATCH": "PAT", "OPTIONS": "OPT"}
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), short.items(), F.replace(csv, F.lit(","), F.lit(" ")))


def confidence(channel: Column, framework: Column) -> Column:
    """How far evidence can be trusted; framework literals and manifests count as parsed."""
    known = framework.isNotNull() & channel.isin("literal", "manifest")
    return F.when(known | channel.isin("manifest", "flight"), "parsed").when(channel.isin("api_call", "route_call", "api_client"), "observed").when(channel == "server_action", "inferred").otherwise("candidate")
