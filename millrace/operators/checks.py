"""Checks of data: each returns the failing rows, none being a pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_unique(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of non-null values that occur more than once."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def is_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNull())


def not_accepted(rows: DataFrame, column: str, values: Sequence) -> DataFrame:
    """(value, n) of non-null values outside ``values``."""
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(values))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def broken_relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of ``child`` whose non-null value no row of ``parent`` has."""
    keys = parent.select(F.col(parent_column).alias("__key")).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")


@dataclass(frozen=True)
class CheckResult:
    name: str
    failures: int
    severity: str = "error"

    @property
    def passed(self) -> bool:
        return self.failures == 0 or self.severity == "warn"


def run_check(name: str, failing: DataFrame, severity: str = "error") -> CheckResult:
    return CheckResult(name, failing.count(), severity)
