"""Proportional stratified interleaving into shards (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import numbered, stored, unit, utf8_bytes


def _numbered(rows: DataFrame, group: list[str], spot: Column, order: list[str], cells: int) -> DataFrame:
    """Adds ``_n``, 1, 2, … within ``group`` by ``order``, where ``spot`` in [0, 1) rises with ``order``.

    A group is cut into ``cells`` by ``spot``; rows are numbered within a cell and
    the rows of the cells before are added. No task holds more than a cell,
    however large the group is.
    """
    rows = rows.withColumn("_cell", F.least(F.floor(spot * cells), F.lit(cells - 1)).cast("int"))
    sizes = rows.groupBy(*group, "_cell").agg(F.count("*").alias("_k"))
    # one row for each group and cell: its size follows the parameter, not the rows
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_total", F.sum("_k").over(every))
    keys = [*group, "_cell"]
    sizes = sizes.select(*[F.col(k).alias(f"{k}_of") for k in keys], "_before", "_total")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    joined = rows.join(sizes, same).drop(*[f"{k}_of" for k in keys])
    w = Window.partitionBy(*keys).orderBy(*order)
    return joined.withColumn("_n", F.row_number().over(w) + F.col("_before")).drop("_before", "_cell")


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_n``, 1, 2, … by ``order`` over all rows, and ``_total``.

    Spark cuts the rows into ranges of about equal size by a sample of all of ``order``, so many
    rows of the same first value (as where most sources have a row) are cut as well. The
    cut is written down, as another run might cut elsewhere.
    """
    rows = stored(rows.repartitionByRange(*order).withColumn("_cell", F.spark_partition_id()))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_k"))
    # one row for each range: its size follows the number of partitions, not the rows
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_cell", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_total"))
    w = Window.partitionBy("_cell").orderBy(*order)
    return rows.join(F.broadcast(sizes), "_cell").withColumn("_n", F.row_number().over(w) + F.col("_before")).drop("_before", "_cell")


def shard(
    docs: DataFrame, shards: int = 40, seed: str = "shards", source: str = "source", keep: list[str] | None = None, cells: int = 1024
) -> DataFrame:
    """Deals rows into ``shards`` of sizes at most one apart, each with the mixture of the whole.

    The rows of a source are shuffled by a seeded hash and ranked; row r of n gets
    the fractional rank (r - 0.5) / n; all rows are sorted by it and cut at equal
    counts. So a shard's share of a source differs from the whole's by about a row.

    Returns ``doc_id``, the columns in ``keep``, ``shard`` and ``slot`` (from 0,
    without gaps). A null source is a source of its own. Rows alike in id and text
    are interchangeable; equal ids with unlike texts are told apart by the text's
    hash. Copies of a text are dealt like any other rows, so a group of equal texts spreads over
    the shards and none of them grows with it. An empty table gives an empty table. Names in ``docs`` other than
    ``doc_id``, ``text`` and the source don't matter; ``cells`` bounds what one
    task sorts: raise it with the rows (1024 cells hold 10^9 rows of a source well).
    """
    keep = [c for c in (keep or []) if c != "doc_id"]
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.col(source).alias("_s"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_t") if "text" in docs.columns else F.lit("").alias("_t"),
        F.struct(*[F.col(c) for c in keep]).alias("_keep") if keep else F.lit(None).alias("_keep"),
    )
    rows = rows.withColumn("_u", unit(seed, F.col("_id"), F.col("_t")))
    rows = _numbered(rows, ["_s"], F.col("_u"), ["_u", "_id", "_t"], cells)
    rows = rows.withColumn("_f", (F.col("_n") - 0.5) / F.col("_total")).drop("_n", "_total")
    rows = _ranged(rows, ["_f", "_u", "_id", "_t", "_s"])
    place, total = F.col("_n") - 1, F.col("_total")
    rows = rows.withColumn("shard", F.floor(place * shards / total).cast("int"))
    first = F.ceil(F.col("shard") * total / F.lit(shards))
    return rows.select(
        F.col("_id").alias("doc_id"), *[F.col(f"_keep.{c}").alias(c) for c in keep], "shard", (place - first).cast("long").alias("slot")
    )


def deal(docs: DataFrame, shards: int = 40, **how) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` added, which replace columns of these names. Texts are shuffled once.

    Every row is dealt once, also where rows repeat or ids are null; other columns pass unchanged, whatever their names.
    """
    rows = numbered(docs)
    place = shard(rows.select("own.doc_id", "own.text", "own.source", "_file", "_row"), shards, keep=["_file", "_row"], **how)
    place = place.select("_file", "_row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    out = rows.join(place, ["_file", "_row"])
    return out.select(*[F.col("own").getField(c).alias(c) for c in kept], F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def op8_interleave(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the ``rows`` law."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "source", (utf8_bytes() + 16).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    out = shard(docs, 40, keep=["size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 bit by bit over the bytes: slow, but whole.
CRC32_SQL = """CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_table[CAST((xor(c, b) & 255) + 1 AS INT)]))) AS BIGINT)"""

ORDER_SQL = """row_number() OVER (PARTITION BY source ORDER BY u, doc_id, t) AS r, count(*) OVER (PARTITION BY source) AS n"""


def unit_sql(seed: str, *parts: str) -> str:
    key = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts]])
    return f"(CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"


def shard_sql(rows: str, shards: int = 40, seed: str = "shards") -> str:
    """SQL of ``shard`` over a relation with ``doc_id``, ``text`` and ``source``; adds ``shard`` and ``slot``."""
    return f"""SELECT * EXCLUDE (t, u, r, n, p, total), p - CAST(ceil(shard * total / {shards}.0) AS BIGINT) AS slot FROM (
        SELECT *, CAST(floor(p * {shards} / total) AS INTEGER) AS shard FROM (
        SELECT *, row_number() OVER (ORDER BY (r - 0.5) / n, u, doc_id, t, source NULLS FIRST) - 1 AS p, count(*) OVER () AS total FROM (
        SELECT *, {ORDER_SQL} FROM (SELECT *, {unit_sql(seed, 'doc_id', 't')} AS u FROM (
        SELECT *, md5(coalesce(text, '')) AS t FROM {rows})))))"""


ORACLE = f"""WITH RECURSIVE crc(i, c, k) AS (SELECT i, i, 0 FROM range(256) v(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
    crcs AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS crc_table FROM crc WHERE k = 8)
    SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, {CRC32_SQL} AS text_crc32, 'rows' AS law, shard, slot,
    CAST(NULL AS INTEGER) AS grown_shard FROM ({shard_sql('documents')}), crcs"""
