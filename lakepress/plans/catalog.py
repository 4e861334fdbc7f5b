"""Every registered query and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from . import asof, engines, intervals, landed, relational, reporting, sources, streams
from .domain import DUCK, SPARK, run_sql, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _sql(body: str) -> Callable:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, body)


QUERIES |= {k: _sql(b) for k, b in relational.bodies(SPARK).items()}
ORACLES |= {k: with_views(DUCK, b) for k, b in relational.bodies(DUCK).items()}
assert asof and intervals and landed and reporting and sources and streams  # their queries are among those of engines
QUERIES |= engines.QUERIES
ORACLES |= engines.ORACLES
