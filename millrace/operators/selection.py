"""Include and exclude lists of names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Names up to which a list is part of the plan, and up to which it is sent to every task.
INLINE, BROADCAST = 1_000, 1_000_000


def _names(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    kind = rows.schema[column].dataType.simpleString()
    listed = rows.sparkSession.createDataFrame([(n,) for n in names], f"{column} {kind}")
    return F.broadcast(listed) if len(names) <= BROADCAST else listed


def include(rows: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Rows whose ``column`` is listed; a null is never listed."""
    names = list(names)
    if len(names) <= INLINE:
        return rows.where(F.col(column).isin(names))
    return rows.join(_names(rows, column, names), column, "left_semi")


def exclude(rows: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Rows whose ``column`` is not listed; rows with a null stay (``NOT IN`` would drop them)."""
    names = [n for n in names if n is not None]
    if len(names) <= INLINE:
        return rows.where(F.coalesce(~F.col(column).isin(names), F.lit(True)))
    return rows.join(_names(rows, column, names), column, "left_anti")


def inventory(
    rows: DataFrame, column: str, org_column: str, org: str, only: Iterable[str] = (), ignore: Iterable[str] = ()
) -> DataFrame:
    """Rows of one organisation, after the include list (if any) and the exclude list (which wins)."""
    out = rows.where(rows[org_column] == org)
    only, ignore = list(only), list(ignore)
    if only:
        out = include(out, column, only)
    return exclude(out, column, ignore) if ignore else out
