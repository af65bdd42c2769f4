"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import aggregation, lookup, more, scalar, sheet, stored, structures  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
