"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


_REGISTERED: dict[str, Query] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(run):
        _REGISTERED[run.__name__] = Query(run, oracle)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> dict[str, Query]:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(_REGISTERED)
