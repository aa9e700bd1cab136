"""Files of several formats, read with a declared schema and written in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Options that make a round trip keep what it got.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
OPTIONS = {
    "csv": {"header": True, "multiLine": True, "escape": '"', "nullValue": "\\N", **TIMES},
    "json": {"ignoreNullFields": False, **TIMES},
    "orc": {},
    "parquet": {},
}


def read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of ``path``; the schema is declared, so nothing is read to guess it."""
    return spark.read.options(**OPTIONS[kind]).schema(schema).format(kind).load(path)


def write(rows: DataFrame, path: str, kind: str, by: list[str] | None = None) -> None:
    """Writes ``rows``, in folders by the columns ``by`` (which later reads can prune by)."""
    rows.write.options(**OPTIONS[kind]).mode("overwrite").partitionBy(*(by or [])).format(kind).save(path)


def read_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database over JDBC, read in ``parts`` by ranges of a whole-number column; filters and columns are pushed down."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
