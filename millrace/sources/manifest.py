"""Project manifests (one JSON document per file) and JSON inventories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.selection import inventory

#: Declared, because inference drops a field whose value is an empty object.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())),
        T.StructField("agents", T.ArrayType(T.StringType())),
    ]
)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file under ``path``."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def import_projects(
    spark: SparkSession, root: str, org: str, only: Iterable[str] = (), ignore: Iterable[str] = (), workspace: str | None = None, dry_run: str | None = None
) -> DataFrame:
    """The whole import: scans ``root``/<org>/<repository>/*.json, keeps one organisation and its listed repositories, and says where they would go.

    With ``dry_run`` the inventory is written there as JSON. Nothing is sent anywhere. Without a ``workspace`` it is null.
    """
    found = read_manifests(spark, f"{root.rstrip('/')}/*/*/*.json").select("*", F.split("_metadata.file_path", "/").alias("_path"))
    place = lambda i: F.url_decode(F.element_at("_path", i))
    rows = found.select(place(-3).alias("org"), place(-2).alias("repo"), F.lit(workspace).cast("string").alias("workspace"), "name", "mode", "dependencies", "agents")
    rows = inventory(rows, "repo", "org", org, only, ignore)
    if dry_run:
        write_inventory(rows, dry_run)
    return rows


def write_inventory(rows: DataFrame, path: str) -> None:
    """The dry-run output: JSON lines, nothing sent anywhere."""
    rows.write.mode("overwrite").json(path)
