"""The registered queries of the library's own operators."""

from __future__ import annotations

from taskweave.plans import evaluation, features, models, panel, prepare, scoring, splits, streams  # noqa: F401  (they register)
from taskweave.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
