"""The library's registered queries and their SQL equivalents."""

from __future__ import annotations

from lodestar.plans import graphs, hashing, keyed, members, spatial, statistics  # noqa: F401  (each registers its queries)
from lodestar.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
