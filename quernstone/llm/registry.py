"""The numbered queries of the entry file, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from quernstone.llm.sql import ORACLES

    return dict(ORACLES)
