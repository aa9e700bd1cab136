"""Benchmark decontamination by spaced-seed hashing (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered

#: Fixed masks of weight 6: 1 marks a token position that must agree, 0 one that is ignored.
MASKS = ("1110111", "11011011", "11001010011")
#: What parts tokens: everything but letters and digits.
BREAK = r"[^\p{L}\p{N}]+"
#: Seeds with their windows that are sent to every task at most (some 40 MB).
BROADCAST_ROWS = 200_000


def tokens(text: str) -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BREAK), "")


def _hashed(words: Column) -> Column:
    """Tokens as 64-bit hashes, made once for all masks."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(mask: str, number: int, words: str, at: Column) -> Column:
    """Hash of the masked tokens from ``at`` on; null where the mask runs over the end."""
    picked = [F.get(F.col(words), at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(number), *picked))


def _seeded(rows: DataFrame, words: str, masks: tuple) -> DataFrame:
    """Adds ``at`` and ``h`` for every position and mask; ``m`` is the mask's number."""
    short = min(map(len, masks))
    # a condition on the sequence and not a filter, which would make the tokens twice
    rows = rows.withColumn("at", F.explode(F.when(F.size(words) >= short, F.sequence(F.lit(0), F.size(words) - short))))
    seeds = [_seed(m, i, words, F.col("at")) for i, m in enumerate(masks)]
    return rows.select("*", F.posexplode(F.array(*seeds)).alias("m", "h")).where("h IS NOT NULL")


def _short_masks(items: DataFrame, masks: tuple) -> tuple:
    """A mask of ones for each length of items that are shorter than all masks: such an item must agree whole."""
    least = min(map(len, masks))
    lengths = items.select(F.size("words").alias("n")).where((F.col("n") > 0) & (F.col("n") < least)).distinct()
    return tuple("1" * r["n"] for r in lengths.orderBy("n").collect())  # as many rows as there are such lengths


def windows(items: DataFrame, masks: tuple, window: int = 20) -> DataFrame:
    """``h``, ``ctx``, ``off``, ``item``: each seed with the tokens around it and its place among them.

    ``items`` has ``words`` and ``item``. The window has ``window`` tokens, centred on the seed, moved inwards at the
    ends of the item, and is the whole item if that is shorter. Like windows of different items are one; ``item`` is the least id.
    """
    spans = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("m") + 1)
    whole = F.element_at(F.array(*[F.lit("0" not in m) for m in masks]), F.col("m") + 1)
    left = F.greatest(F.lit(0), F.least(F.col("at") - F.floor((window - spans) / 2), F.size("words") - window)).cast("int")
    rows = _seeded(items, "words", masks).where(~whole | (spans == F.size("words"))).withColumn("_from", left)
    rows = rows.select("h", F.slice("words", F.col("_from") + 1, F.lit(window)).alias("ctx"), (F.col("at") - F.col("_from")).alias("off"), "item")
    return rows.groupBy("h", "ctx", "off").agg(F.min("item").alias("item"))


def _overlap(near: str, place: str, w: Column) -> Column:
    """Share of the window's tokens that the document has at the same places; the seed is at ``place`` of ``near``."""
    start = F.col(place) - w["off"]
    lack = F.greatest(-start, F.lit(0))
    own = F.slice(near, F.greatest(start, F.lit(0)) + 1, F.greatest(F.size(w["ctx"]) - lack, F.lit(0)))
    due = F.slice(w["ctx"], lack + 1, F.size(w["ctx"]))
    return F.size(F.filter(F.zip_with(own, due, lambda a, b: a == b), lambda x: x)) / F.size(w["ctx"])


def hits(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, masks: tuple = MASKS, window: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, ``at``, ``item``, ``overlap`` of each hit of a seed around which at least ``least`` of a window agrees.

    Positions of the documents are joined with the benchmark's seeds and never
    leave their task if the seeds are few enough to be sent there, which is
    counted first. Otherwise hashes are shuffled, without texts, and the tokens of
    the documents that were hit are joined again. A seed is one row with all its windows, so one
    that many items and many documents hold makes a row for each place in the documents, not for each pair.
    """
    items = benchmark.select(_hashed(tokens("text")).alias("words"), F.col("item_id")).groupBy("words").agg(F.min("item_id").alias("item"))
    masks = masks + _short_masks(items, masks)
    found = windows(items, masks, window)
    few = found.limit(broadcast_rows + 1).count() <= broadcast_rows
    seeds = found.groupBy("h").agg(F.collect_list(F.struct("ctx", "off", "item")).alias("wins"))
    own = docs.select("doc_id", _hashed(tokens("text")).alias("words"))
    if few:
        rows = _seeded(own, "words", masks).join(F.broadcast(seeds), "h")
    else:
        own = own.withColumn("t", F.xxhash64("words"))
        thin = _seeded(own, "words", masks).select("doc_id", "t", "at", "h").join(seeds.select("h"), "h", "left_semi").withColumnRenamed("doc_id", "_id").withColumnRenamed("t", "_t")
        rows = thin.join(own.dropDuplicates(["doc_id", "t"]), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("t")))
    first = F.greatest(F.col("at") - window, F.lit(0))
    near = F.slice("words", first + 1, F.lit(2 * window + max(map(len, masks)))).alias("near")
    if few:
        rows = rows.select("doc_id", "at", "wins", near, (F.col("at") - first).alias("place"))
    else:
        rows = rows.select("doc_id", "at", "h", near, (F.col("at") - first).alias("place")).join(seeds, "h")
    # the second use of ``near`` keeps the optimizer from moving the slice here: cut out within the
    # join's generated code, it saves copying a document's tokens for each hit
    scored = F.transform("wins", lambda w: F.struct(w["item"].alias("item"), F.when(F.size("near") > 0, _overlap("near", "place", w)).alias("overlap")))
    rows = rows.select("doc_id", "at", F.explode(F.filter(scored, lambda x: x["overlap"] >= least)).alias("hit"))
    return rows.select("doc_id", "at", "hit.item", "hit.overlap")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, **how) -> DataFrame:
    """``doc_id``, ``n_hits``, ``overlap`` and ``items`` of the documents that hold a benchmark passage.

    A document holds one if, around some hit of a seed, at least ``least`` (0.8) of
    the window's tokens agree place by place, so up to a fifth may be substituted.
    An item of fewer tokens than the shortest mask matches where all its tokens stand in a row.
    Null and empty texts, and an empty benchmark, give no hit; rows of the same doc_id (null
    included) share a verdict here (``decontaminate`` judges rows). Texts of any length are read whole.
    """
    found = hits(docs, benchmark, least, **how).groupBy("doc_id")
    return found.agg(F.count("*").alias("n_hits"), F.max("overlap").alias("overlap"), F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage, columns unchanged, whatever their names.

    Each row is judged by itself, also where doc_ids repeat or are null.
    """
    rows = numbered(docs)
    bad = contaminated(rows.select(F.struct("_file", "_row").alias("doc_id"), F.col("own.text").alias("text")), benchmark, **how).select("doc_id.*")
    return rows.join(bad, ["_file", "_row"], "left_anti").select("own.*")


clean_rows = decontaminate


def op3_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bad = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("doc_id", "_bad")
    out = docs.select("doc_id").join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left")
    return out.select(
        "doc_id", F.col("n_hits").isNotNull().alias("contaminated"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
    )


def contaminated_sql(docs: str) -> str:
    """SQL of ``contaminated`` over a relation with ``doc_id`` and ``text``."""
    def seeds(words: str) -> str:
        masks = [*MASKS, *("1" * k for k in range(1, min(map(len, MASKS))))]
        return " UNION ALL ".join(
            f"SELECT *, '{mask}' AS m, {len(mask)} AS span, concat_ws(' ', {', '.join(f'words[p + {k + 1}]' for k, b in enumerate(mask) if b == '1')}) AS h "
            f"FROM (SELECT *, unnest(range(len(words) - {len(mask) - 1})) AS p FROM {words} WHERE len(words) {'>=' if '0' in mask or words != 'it' else '='} {len(mask)}"
            f"{'' if '0' in mask else f' AND {len(mask)} IN (SELECT len(words) FROM it)'})"
            for mask in masks
        )

    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""WITH it AS (SELECT {words} AS words, min(item_id) AS item FROM benchmark GROUP BY 1),
    iseed AS (SELECT m, h, p - lo AS off, words[lo + 1 : lo + 20] AS ctx, item FROM (SELECT *, greatest(0, least(p - CAST(floor((20 - span) / 2) AS BIGINT),
        len(words) - 20)) AS lo FROM ({seeds('it')}))),
    ctxs AS (SELECT m, h, off, ctx, min(item) AS item FROM iseed GROUP BY ALL),
    dw AS (SELECT doc_id, {words} AS words FROM {docs}),
    found AS (SELECT doc_id, item, len(list_filter(range(len(ctx)), lambda i: p - off + i >= 0 AND coalesce(words[p - off + i + 1] = ctx[i + 1], false)))
        / len(ctx)::DOUBLE AS overlap FROM ({seeds('dw')}) d JOIN ctxs c ON d.m = c.m AND d.h = c.h)
    SELECT doc_id, count(*) AS n_hits, max(overlap) AS overlap, list_sort(list(DISTINCT item)) AS items FROM found WHERE overlap >= 0.8 GROUP BY doc_id"""


ORACLE = f"""SELECT d.doc_id, n_hits IS NOT NULL AS contaminated, coalesce(n_hits, 0) AS n_hits, coalesce(overlap, 0.0::DOUBLE) AS overlap,
    coalesce(array_to_string(items, ','), '') AS items FROM documents d LEFT JOIN ({contaminated_sql('documents')}) b ON d.doc_id = b.doc_id"""
