"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import numbered, unit, word_count
from millrace.llm.sharding import unit_sql

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3  # epochs at most


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, budget: float | None = None) -> DataFrame:
    """``source_size`` by source to ``target`` by source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the budget (all sizes, if none is given). A target stops at ``most`` times its
    source's size and what is left over is shared anew by weight among the rest,
    until none is above. With cap/weight sorted, the sources that stop are a
    prefix: the water level rises past them one by one, which a running sum finds.
    The table has a row for each source and is sorted in one task: good for some millions of sources
    (a few dozen bytes each, spilled beyond memory); names finer than that should be put together first.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))).withColumn("_w", w)
    rows = rows.withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    below = Window.orderBy("_r", "_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_budget", F.sum("source_size").over(every).cast("double") if budget is None else F.lit(float(budget)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(below), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_left"))
        .withColumn("_stops", F.col("_r") <= F.col("_level"))
    )
    level = F.min(F.when(~F.col("_stops"), F.struct("_r", "_i", "_level"))).over(every)["_level"]
    return rows.withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(level * F.col("_w"))).select(
        "source", "source_size", "target"
    )


def mix(
    docs: DataFrame, seed: str = "mix", quality: str | None = None, labels: DataFrame | None = None, weights: tuple = WEIGHTS, most: int = MOST, keep: list[str] | None = None,
    cells: int = 1024,
) -> DataFrame:
    """How many words of each document the mixture takes.

    ``docs`` has ``doc_id``, ``text``, ``source`` and perhaps a positive
    ``quality`` column; otherwise the weight can come from ``labels`` (see ``with_quality``). A target of e whole source sizes and a rest takes every
    document e times (complete epochs) and then, for the rest, whole documents in
    order of an exponential key E / quality, the Efraimidis-Spirakis order, while at least
    half of the next one still fits. So a source misses its target by at most
    half of its largest document.

    Returns ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and the
    columns in ``keep``. Null texts have size 0 and are taken never; a null source is one source;
    null, non-positive or non-finite quality counts as 1. Rows alike in every
    way are ordered arbitrarily, which gives equal results. A source's running
    sum is cut into ``cells`` by the key, so no task holds a whole source.
    """
    keep = [c for c in (keep or []) if c not in ("doc_id", "size")]
    q = F.col(quality).cast("double") if quality else F.lit(1.0)
    q = F.when((q > 0) & (q < F.lit(float("inf"))), q).otherwise(1.0)
    rows = docs.select(
        "doc_id", F.col("source").alias("_s"), word_count().alias("size"), q.alias("_q"), F.md5(F.coalesce("text", F.lit(""))).alias("_t"),
        F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"),
    )
    if labels is not None:
        rows = with_quality(rows, labels, "_q")
    rows = rows.withColumn("_key", -F.log(unit(seed, F.col("doc_id"), F.col("_t"))) / F.col("_q"))
    rows = rows.withColumn("_cell", F.least(F.floor((1 - F.exp(-F.col("_key"))) * cells), F.lit(cells - 1)).cast("int"))
    by_cell = rows.groupBy("_s", "_cell").agg(F.sum("size").alias("_sum"))
    goal = targets(by_cell.groupBy(F.col("_s").alias("source")).agg(F.sum("_sum").alias("source_size")), weights, most)
    before = Window.partitionBy("_s").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_cell.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    cell = by_cell.join(goal, by_cell["_s"].eqNullSafe(goal["source"])).select(
        F.col("_s").alias("_s2"), F.col("_cell").alias("_cell2"), "_before", "source_size", "target"
    )
    rows = rows.join(cell, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_cell") == F.col("_cell2")))
    w = Window.partitionBy("_s", "_cell").orderBy("_key", "doc_id", "_t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ahead", F.col("_before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    times = epochs + ((F.col("_ahead") + F.col("size") / 2) <= rest).cast("long")
    return rows.select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), *[F.col(f"_keep.{c}").alias(c) for c in keep]
    )


def with_quality(docs: DataFrame, labels: DataFrame, name: str = "quality", good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """``docs`` with a weight from the labels: ``good``, ``poor``, or 1 where there is none.

    A document labelled twice counts as good if any label says so.
    """
    best = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("quality").alias("_label"))
    rows = docs.join(best, F.col("doc_id") == F.col("_label_id"), "left")
    weight = F.when(F.col("_label") == 1, good).when(F.col("_label") == 0, poor).otherwise(1.0)
    return rows.withColumn(name, weight).drop("_label_id", "_label")


def take(docs: DataFrame, labels: DataFrame | None = None, **how) -> DataFrame:
    """The mixture itself: each row as often as it is taken, columns unchanged, whatever their names. Texts are shuffled once.

    Rows without words (null or blank texts) are never taken; repeated rows are taken each by itself.
    """
    rows = numbered(docs)
    thin = mix(rows.select("own.doc_id", "own.text", "own.source", "_file", "_row"), labels=labels, keep=["_file", "_row"], **how).where("taken > 0")
    times = thin.select("_file", "_row", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long"))).alias("_copy"))
    return rows.join(times, ["_file", "_row"]).select("own.*")


def op9_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, weighted by the quality labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def mix_sql(rows: str, seed: str = "mix") -> str:
    """SQL of ``mix`` over a relation with ``doc_id``, ``text`` and ``source``, with the labels."""
    return f"""WITH d AS (SELECT d.*, md5(coalesce(text, '')) AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        CASE WHEN best = 1 THEN 2.0 WHEN best = 0 THEN 0.5 ELSE 1.0 END AS q
        FROM {rows} d LEFT JOIN (SELECT doc_id AS l_id, max(quality) AS best FROM labels GROUP BY doc_id) ON d.doc_id = l_id),
    k AS (SELECT *, -ln({unit_sql(seed, 'doc_id', 't')}) / q AS e FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
    w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
    l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
        FROM w WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT source, source_size, CASE WHEN cap / w <= level THEN cap ELSE w * (SELECT arg_min(level, (cap / w, i)) FROM l WHERE cap / w > level) END AS target FROM l),
    r AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY e, doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
        FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
    SELECT *, epochs + CASE WHEN ahead + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END AS times FROM r"""


ORACLE = f"SELECT doc_id, size, source_size, target, CAST(times * size AS BIGINT) AS taken FROM ({mix_sql('documents')})"
