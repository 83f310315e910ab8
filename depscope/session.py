"""Sessions, request limits and paging tokens."""

from __future__ import annotations

import base64
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "depscope", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings come from the submitter."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


class Limit(NamedTuple):
    default: int
    most: int
    least: int = 1


#: Page sizes and depths by request; fixed values.
LIMITS = {
    "package_search": Limit(10, 50), "source_search": Limit(20, 100), "symbol_search": Limit(25, 200), "docs_search": Limit(25, 200),
    "versions": Limit(100, 500), "dependents": Limit(25, 200), "graph_depth": Limit(1, 4), "api_diff": Limit(500, 2000),
    "alternatives": Limit(10, 50), "hotspots": Limit(100, 500), "api": Limit(200, 1000), "resolve": Limit(100, 1000),
    "matrix_versions": Limit(5, 20), "matrix_pairs": Limit(25, 200), "usage": Limit(20, 200), "import_path": Limit(10, 100),
    "error_types": Limit(100, 500), "heavy_features": Limit(5, 100), "readme_chars": Limit(25_000, 200_000, 500), "sync_page": Limit(25, 100),
    "deprecated": Limit(50, 200),
}


def clamp(kind: str, asked: int | None) -> int:
    limit = LIMITS[kind]
    return limit.default if asked is None else max(limit.least, min(limit.most, asked))


def encode_cursor(limit: int, offset: int, filters: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "limit": limit, "offset": offset, "filters": filters}, sort_keys=True).encode()).decode().rstrip("=")


def decode_cursor(token: str, filters: dict) -> tuple[int, int]:
    """(limit, offset) of a token; it must be of version 1, with a limit, and of the same filters."""
    try:
        found = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError as e:
        raise ValueError("cursor cannot be read") from e
    if found.get("v") != 1 or found.get("limit", 0) <= 0:
        raise ValueError("cursor is of another version")
    if found.get("filters") != filters:
        raise ValueError("cursor belongs to other filters")
    return found["limit"], found["offset"]


class Page(NamedTuple):
    rows: DataFrame
    has_more: bool
    next_cursor: str | None


def page(ordered: DataFrame, limit: int, offset: int = 0, filters: dict | None = None) -> Page:
    """One page of rows in a total order; one row more than the limit tells whether others follow."""
    more = ordered.offset(offset).limit(limit + 1).count() > limit
    token = encode_cursor(limit, offset + limit, filters or {}) if more else None
    return Page(ordered.offset(offset).limit(limit), more, token)
