"""Functions of the user's own in the forms that Spark takes: of columns, of groups and of tables. Slower than built-ins.

Each is made by a call, so that it goes to the workers by value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digit_sum():
    """Of whole numbers, a batch at a time; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else sum(map(int, str(abs(int(x)))))).astype("Int64")

    return F.pandas_udf(run, T.LongType())


def spread():
    """Greatest less least value of a group."""

    def run(values: pd.Series) -> float:
        return float(values.max() - values.min())

    return F.pandas_udf(run, T.DoubleType())


def words():
    """A table function: a row for each word of a text, with its place from 1."""

    class Words:
        def eval(self, text: str):
            for i, word in enumerate((text or "").split(), 1):
                yield word, i

    return F.udtf(Words, returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))


def running_totals(groups: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the running sum of ``value`` within ``key`` by ``value``: a function of whole groups, each in one task's memory."""
    schema = groups.select(key, value).schema.add("total", "double")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(value)
        return part.assign(total=part[value].cumsum())

    return groups.select(key, value).groupBy(key).applyInPandas(run, schema)

