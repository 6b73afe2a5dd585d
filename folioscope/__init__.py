"""A PySpark engine for auditing collections of multi-page records."""

from __future__ import annotations

import os


def importable(spark) -> None:
    """Lets Python workers import this package from where the driver did (local sessions and shared folders; else ship it with --py-files)."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
