"""What several operators of this subpackage share."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is
    unset (a local session, as in tests) one under ``/tmp`` is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/millrace-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back: cuts the lineage.

    Unlike a local checkpoint, the copy outlives the executors that made it. The
    shuffle files that led to it are deleted with the write's end.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*copies: DataFrame) -> None:
    """Empties the folders of what ``stored`` returned, once nothing that reads them is left to run."""
    for rows in copies:
        rows.sparkSession.createDataFrame([], rows.schema).write.mode("overwrite").parquet(rows.stored_at)


def few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, of columns of fixed width, marked for a broadcast if they are at most so many, which is counted."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def numbered(rows: DataFrame) -> DataFrame:
    """``_file`` and ``_row``, which name a row, and the row itself as the struct ``own``.

    A plain scan of files is numbered by its files and the places in them, which are
    the same whichever columns are read, so a thin selection can be worked on and joined back even
    where rows repeat. Anything else (joined, exploded, made rows) is written first, as a row of
    a file may stand for several there. No column's name matters, as all are inside the struct.
    """
    if not _plain_scan(rows):
        rows = stored(rows)
    meta = rows.metadataColumn("_metadata")
    return rows.select(
        F.xxhash64(meta["file_path"]).alias("_file"), meta["row_index"].alias("_row"),
        F.struct(*[F.col(_quoted(c)) for c in rows.columns]).alias("own"),
    )


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _plain_scan(rows: DataFrame) -> bool:
    """Whether the plan only reads Parquet files, and selects columns or filters rows."""
    scan = re.compile(r"Relation \[.*\] parquet|LogicalRelation")
    if not hasattr(rows, "_jdf"):  # the plan can't be looked at
        return False
    plan = rows._jdf.queryExecution().analyzed().toString().strip().splitlines()
    return bool(scan.search(plan[-1])) and all(re.match(r"[\s+:-]*(Project|Filter|SubqueryAlias) ", x) for x in plan[:-1])


def utf8_bytes(text: str = "text") -> Column:
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def word_count(text: str = "text") -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unit(seed: str, *columns: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only.

    Made from the first 13 hex digits (52 bits) of an MD5, so that any SQL engine can repeat it.
    """
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


@functools.cache
def _package() -> str:
    """This package as an archive in a temporary folder of the driver, which serves it to the executors."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    return path


def importable(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Python workers can import it."""
    if getattr(spark, "_millrace_sent", None) != spark.sparkContext.applicationId:
        spark.sparkContext.addPyFile(_package())
        spark._millrace_sent = spark.sparkContext.applicationId
