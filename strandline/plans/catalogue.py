"""Where query modules enter their queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .demo import DEMO_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, demo: bool = True):
    """Registers a function under its name; ``sql`` continues the demo graph's views (or stands alone)."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # as in scoring.rounded: a rounded zero has no sign
            unsigned = re.sub(r"(, [5-9]\)) AS (\w)", r"\1 + 0.0 AS \2", sql)
            ORACLES[f.__name__] = f"WITH RECURSIVE {DEMO_SQL.strip()}{unsigned}" if demo else unsigned
        return f

    return enter
