"""As-of join, interval join and sessions, as compositions of built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(at: str, kind: str) -> Column:
    """Whole seconds of a time since 1970: of one without a zone as it reads, whatever the session's zone and its clock changes."""
    c = F.col(at)
    if kind == "timestamp_ntz":
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if kind == "timestamp":
        return F.floor(F.unix_micros(c) / 1_000_000)
    return F.floor(c).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, take: list[str], span_s: int | None = None) -> DataFrame:
    """For each left row the last right row of the same ``by`` at or before it.

    Both sides are stacked and the last right value is carried forward, so the
    cost is one shuffle and one sort instead of a join on an inequality. ``take``
    names right columns; they come back null where no right row precedes. Among
    right rows of equal time the largest ``take`` tuple wins. As in any join, null keys match nothing.

    With ``span_s`` each key's rows are cut into spans of so many seconds, so that a hot key is spread
    over tasks; the last right row of each span is carried over to the next ones.
    """
    right = right.dropna(subset=[*by, right_on])
    kind = left.schema[on].dataType.simpleString()
    lt = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_l"), F.lit(None).cast(
        right.select(F.struct(*take)).schema[0].dataType).alias("_r"))
    rt = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(
        left.select(F.struct("*")).schema[0].dataType).alias("_l"), F.struct(*take).alias("_r"))
    both, keys = lt.unionByName(rt), list(by)
    if span_s:
        both, keys = both.withColumn("_span", F.floor(seconds("_t", kind) / span_s)), [*by, "_span"]
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    if span_s:
        ends = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r")))["_r"].alias("_end"))
        before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(before)).withColumnsRenamed({k: f"{k}_of" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
        carried = carried.join(ends, same, "left").withColumn("_r", F.coalesce("_r", "_end"))
    return carried.where("_side = 1").select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in take])


def interval_join(
    points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width_s: int, by: list[str] | None = None
) -> DataFrame:
    """Points inside ``[start, end)`` spans, by equality on time buckets.

    Each span is listed under every bucket of ``width_s`` seconds it touches, so
    the join is an equality join (hash or merge, skew-splittable) with the exact
    bounds as a residual. Choose the width near the median span. Times may be timestamps,
    with or without a zone, or numbers of seconds.
    """
    bucket = lambda rows, c: F.floor(seconds(c, rows.schema[c].dataType.simpleString()) / width_s)
    p = points.withColumn("_b", bucket(points, at))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(spans, start), bucket(spans, end))))
    keys = ["_b", *(by or [])]
    return p.join(s, keys).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, below: float, above: float) -> DataFrame:
    """All pairs with ``a - below <= b <= a + above``, of columns of unlike names, by equality on buckets of numbers.

    Right rows are in one bucket, left ones are listed under the two or three that their band touches. Nulls match nothing.
    """
    width = float(below + above) or 1.0
    bucket = lambda c: F.floor(c / width)
    l_ = left.withColumn("_b", F.explode(F.sequence(bucket(F.col(a) - below), bucket(F.col(a) + above))))
    r = right.withColumn("_b", bucket(F.col(b)))
    return l_.join(r, "_b").where((F.col(b) >= F.col(a) - below) & (F.col(b) <= F.col(a) + above)).drop("_b")


def pairs_in_order(rows: DataFrame, value: str, width: float, name: str = "n") -> DataFrame:
    """The number of pairs of rows of which the first has the smaller ``value``, without making a pair.

    Values are counted in buckets of ``width``; running sums go over the buckets and within each, so no
    task sorts all values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_k")).withColumn("_b", F.floor(F.col(value) / width))
    sums = counts.groupBy("_b").agg(F.sum("_k").alias("_s"))
    sums = sums.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_own", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    return inside.join(sums, F.col("_b") == F.col("_c")).agg(F.coalesce(F.sum(F.col("_k") * (F.col("_own") + F.col("_before"))), F.lit(0)).cast("long").alias(name))


def session_ids(rows: DataFrame, by: str, at: str, tie: str, gap: str) -> DataFrame:
    """Adds ``session``: 1, 2, … within ``by``, a new one after a gap longer than ``gap``."""
    w = Window.partitionBy(by).orderBy(at, tie)
    new: Column = F.lag(at).over(w).isNull() | (F.col(at) > F.lag(at).over(w) + F.expr(f"interval {gap}"))
    return rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")
