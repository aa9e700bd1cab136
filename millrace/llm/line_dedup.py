"""Near-duplicate lines by an exact set-similarity join (native)."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, few, stored

#: Jaccard of at least UP / DOWN = 0.8, in whole numbers.
UP, DOWN = 4, 5
#: What a token is: letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
#: Hash buckets (as a power of two) by which the rarity of tokens is counted.
BITS = 18
#: Tokens of a line up to which one half of the signature tells lines apart.
SHORT = 70
#: Classes from which a bucket has leaders.
GROUP = 16
#: Parts of a bucket, by the classes' hashes, whose first members lead it.
LEADERS = 8
#: Earlier classes, the likest ones, that a class is compared with before the rest of its candidates.
NEAREST = 4
#: Classes or places of lines, of a few longs each, sent to every task at most (some 10 MB).
BROADCAST_ROWS = 200_000


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no`` (from 0) and ``line`` of all lines, parted by line feeds."""
    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def words_of(line: str) -> Column:
    """The different lower-case tokens of a line as 64-bit hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w)))


def hashed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``crc`` (the line's hash) and ``words`` (different tokens as 64-bit hashes) of the lines that have tokens."""
    rows = lines(docs).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    return rows.select("doc_id", "line_no", F.xxhash64("line").alias("crc"), words_of("line").alias("words"))


def held(docs: DataFrame) -> DataFrame:
    """``hashed`` lines, kept on the executors' disks from their first use on: they are written and read faster than Parquet, and cut anew if an executor is lost."""
    return hashed(docs).persist(StorageLevel.DISK_ONLY)


def rarity(rows: DataFrame, bits: int) -> str:
    """How frequent the tokens of each of 2^bits hash buckets are: twice the binary logarithm of the number of lines they stand in, parted by commas.

    Counted in longs over all of the ``hashed`` lines, so no count is cut off. The table's size
    follows ``bits`` alone (under 1 MB at 18), whatever the input; where the vocabulary is much
    larger than 2^bits, rare tokens share buckets, which costs time and no pair.
    """
    slot = F.shiftrightunsigned("w", 64 - bits).alias("i")
    counts = stored(rows.select(F.explode("words").alias("w")).groupBy(slot).agg(F.count("*").alias("n")))  # so that its shuffle files go
    every = rows.sparkSession.range(0, 1 << bits, 1, 8).withColumnRenamed("id", "j").join(counts, F.col("i") == F.col("j"), "left")
    level = F.floor(2 * F.log2(F.coalesce("n", F.lit(1)))).cast("string")
    row = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", level.alias("c")))), lambda x: x["c"]), ",").alias("levels"))
    levels = row.first()["levels"]
    discard(counts)
    return levels


def _codes(words: str, levels: str, bits: int) -> Column:
    """The hashes of a line's different tokens, rarest first, as longs: the bucket's level above 56 bits of the hash, the bucket's number among them.

    Equal tokens have equal codes, so the filters that work on codes lose no pair;
    unlike tokens hardly ever share one, and the verification doesn't use codes.
    """
    table = F.split(F.lit(levels), ",").cast("array<long>")  # folded to a constant once

    def code(h: Column) -> Column:
        level = F.get(table, F.shiftrightunsigned(h, 64 - bits).cast("int"))
        # never null, so that plain longs are sorted
        return F.coalesce(F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))

    return F.sort_array(F.transform(words, code))


def classes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Lines of the same token set as one: its size ``n``, ``id``, first place, ``crc``, ``prefix`` of codes, ``s0`` and ``s1``.

    A prefix has n - ceil(0.8 n) + 1 codes: sets that reach the threshold share one.
    Bit b of the signature is the parity of the number of tokens that hash to b: of 64 bits in
    ``s0`` for sets of up to SHORT tokens, of 128 in ``s0`` and ``s1`` for longer ones.
    """
    cut = held(docs)
    sets = classes_of(cut, bits)
    cut.unpersist(blocking=True)
    return sets


def classes_of(cut: DataFrame, bits: int) -> DataFrame:
    """``classes`` of ``hashed`` lines, which are read twice."""
    rows = cut.select("doc_id", "line_no", "crc", _codes("words", rarity(cut, bits), bits).alias("codes"))
    rows = rows.withColumn("n", F.size("codes"))
    prefix = F.slice("codes", F.lit(1), F.col("n") - F.ceil(F.col("n") * UP / DOWN).cast("int") + 1)
    parity = lambda bit: F.expr(f"aggregate(codes, 0L, (s, c) -> s ^ shiftleft({bit}, cast(c & 63L as int)))")
    rows = rows.select("*", parity("1L").alias("s"), F.when(F.col("n") > SHORT, parity("shiftrightunsigned(c, 6) & 1L")).otherwise(0).alias("s1"))
    at = F.struct("doc_id", "line_no", "crc", prefix.alias("prefix"), F.col("s").bitwiseXOR(F.col("s1")).alias("s0"), "s1")
    rows = rows.select("n", F.xxhash64("codes").alias("id"), F.xxhash64(F.lit(1), "codes").alias("h2"), at.alias("at"))
    # by the hash first, on which rows sort fast
    return stored(rows.groupBy("id", "h2", "n").agg(F.min("at").alias("at")).select("n", "id", "at.*"))


def _unlike(n1: Column, a: tuple[Column, Column], n2: Column, b: tuple[Column, Column]) -> Column:
    """Bits in which signatures differ, which unlike tokens are at least. Halves that are exclusively or-ed make the shorter signature."""
    x, y = a[0].bitwiseXOR(b[0]), a[1].bitwiseXOR(b[1])
    return F.when((n1 <= SHORT) | (n2 <= SHORT), F.bit_count(x.bitwiseXOR(y))).otherwise(F.bit_count(x) + F.bit_count(y))


def _alike(n1: Column, a: tuple[Column, Column], n2: Column, b: tuple[Column, Column]) -> Column:
    """The length and signature filters: unlike tokens are at most (1 - t) / (1 + t) of both sizes at a Jaccard of t."""
    return (n1 * DOWN >= n2 * UP) & (n2 * DOWN >= n1 * UP) & (_unlike(n1, a, n2, b) * (UP + DOWN) <= (n1 + n2) * (DOWN - UP))


def leading(sets: DataFrame, group: int = GROUP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (``x``, ``y``) of a class and the first ones of its buckets' LEADERS parts, if the filters pass them.

    A bucket has the same first, second or third pair of codes among those of the prefix that
    stand in ``group`` lines or more, and ``group`` classes or more. Own words of near copies are rarer or stand behind, so a
    large group of near copies is settled by its first members; pairs of codes hardly ever
    meet so often otherwise. There are 3 LEADERS pairs a class at most, however many are alike, and what no leader settles
    the join looks up.
    """
    often = F.filter("prefix", lambda c: c >= F.lit(math.floor(2 * math.log2(group)) << 56))
    two = lambda i: F.when(F.size("often") > i, F.xxhash64(F.get("often", F.lit(i)), F.get("often", F.lit(i + 1))))
    rows = sets.where("n > 3").select("n", "id", "s0", "s1", F.struct("doc_id", "line_no").alias("o"), often.alias("often"))
    rows = rows.select("n", "id", "s0", "s1", "o", F.explode(F.array_compact(F.array(two(0), two(2), two(4)))).alias("key"))
    large = stored(rows.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") >= group).select("key"))
    rows = stored(rows.join(few(large, broadcast_rows), "key", "left_semi"))
    row = F.struct("o", "id", "n", "s0", "s1")
    leaders = [F.min(F.when(F.pmod("id", F.lit(LEADERS)) == i, row)) for i in range(LEADERS)]
    first = rows.groupBy("key").agg(F.array_compact(F.array(*leaders)).alias("fs"))
    both = rows.join(first, "key").select("n", "id", "s0", "s1", "o", F.explode("fs").alias("f"))
    alike = _alike(F.col("f.n"), (F.col("f.s0"), F.col("f.s1")), F.col("n"), (F.col("s0"), F.col("s1")))
    pairs = stored(both.where((F.col("f.o") < F.col("o")) & alike).select(F.col("f.id").alias("x"), F.col("id").alias("y")).distinct())
    discard(large, rows)
    return pairs


def candidates(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs of classes ``x``, ``y``, the later of which isn't ``settled`` (an ``id`` each), that pass the prefix, length, positional and signature filters.

    The smaller set of a pair is looked up by its first n - ceil(2 t / (1 + t) n) + 1 codes only,
    as both are at least as large, the greater by its whole prefix. Only an open class asks for earlier ones, so of a
    group of near copies just those that no first member settled make pairs, and only backwards. Classes
    that start in the same document are paired if either is open. ``asks`` is the later one (null in the
    same document), ``far`` in how many bits the signatures differ.
    """
    # one long holds the size, whether the class is open and the code's place
    state = (F.shiftleft(F.col("n").cast("long"), 32) + F.when(F.col("s").isNull(), 1 << 31).otherwise(0)).alias("m")
    rows = sets.where("n > 3").join(settled.select("id", F.lit(True).alias("s")), "id", "left").select("n", "id", "doc_id", "s0", "s1", state, "prefix")
    index = F.slice("prefix", F.lit(1), F.col("n") - F.ceil(F.col("n") * 2 * UP / (UP + DOWN)).cast("int") + 1)
    entries = lambda codes: rows.select("id", "doc_id", "s0", "s1", "m", F.posexplode(codes).alias("i", "code")).select("code", "id", "doc_id", "s0", "s1", F.col("m") + F.col("i"))
    is_open = lambda m: m.bitwiseAND(F.lit(1 << 31)) != 0
    a = entries(index).toDF("code", "x", "d1", "a0", "a1", "m1")
    b = entries(F.col("prefix")).toDF("code", "y", "d2", "b0", "b1", "m2")
    n1, n2 = F.shiftright("m1", 32), F.shiftright("m2", 32)
    i1, i2 = F.col("m1").bitwiseAND(F.lit((1 << 31) - 1)), F.col("m2").bitwiseAND(F.lit((1 << 31) - 1))
    once = (n1 < n2) | ((n1 == n2) & (F.col("x") < F.col("y")))
    before = lambda p, q: F.coalesce(F.col(p) < F.col(q), F.col(p).isNull() & F.col(q).isNotNull())
    asked = (is_open(F.col("m1")) & ~before("d1", "d2")) | (is_open(F.col("m2")) & ~before("d2", "d1"))
    # an overlap of t / (1 + t) of both sizes makes a Jaccard of t
    placed = F.least(n1 - i1, n2 - i2) * (UP + DOWN) >= (n1 + n2) * UP
    marks = n1, (F.col("a0"), F.col("a1")), n2, (F.col("b0"), F.col("b1"))
    later = F.when(before("d1", "d2"), F.col("y")).when(before("d2", "d1"), F.col("x"))
    # sizes first: they part most pairs, at the least cost
    found = a.join(b, "code").where((n1 <= n2) & _alike(*marks) & placed & once & asked)
    return found.select("x", "y", later.alias("asks"), _unlike(*marks).alias("far")).distinct()


def words_of_classes(docs: DataFrame, sets: DataFrame, pairs: DataFrame, broadcast_rows: int, cut: DataFrame | None = None) -> DataFrame:
    """``id``, place ``at`` and ``words`` of the classes in pairs of ``x`` and ``y``.

    They are taken from ``cut``, the ``hashed`` lines, if these are still held. Else texts are read again, and only
    the lines of the pairs' classes are cut into tokens. ``crc``, the line's hash, tells rows of the same doc_id apart.
    """
    ids = stored(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
    wanted = stored(sets.join(few(ids, broadcast_rows), "id", "left_semi").select("id", F.col("doc_id").alias("_d"), F.col("line_no").alias("_l"), F.col("crc").alias("_c")))
    own, words = cut, F.col("words")
    if cut is None:
        some = few(wanted.select("_d").distinct(), broadcast_rows)
        own = lines(docs.join(some, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")).withColumn("crc", F.xxhash64("line"))
        words = words_of("line")
    at = (F.col("crc") == F.col("_c")) & (F.col("line_no") == F.col("_l")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    texts = own.join(few(wanted, broadcast_rows), at)
    texts = stored(texts.select("id", F.struct("doc_id", "line_no", "id").alias("at"), words.alias("words")).dropDuplicates(["id"]))  # rows that repeat hold the line twice
    discard(ids, wanted)
    return texts


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``id`` and place of the later one of every pair of ``x`` and ``y`` whose tokens reach the threshold."""
    a, b = texts.toDF("x", "at1", "w1"), texts.toDF("y", "at2", "w2")
    alike = F.size(F.array_intersect("w1", "w2")) * (UP + DOWN) >= (F.size("w1") + F.size("w2")) * UP
    apart = ~F.col("at1.doc_id").eqNullSafe(F.col("at2.doc_id")) | (F.col("at1.line_no") != F.col("at2.line_no"))
    return pairs.join(a, "x").join(b, "y").where(apart & alike).select(F.greatest("at1", "at2").alias("late")).distinct().select("late.*")


def settled_by(docs: DataFrame, sets: DataFrame, pairs: DataFrame, broadcast_rows: int, nearest: int = NEAREST) -> list[DataFrame]:
    """What ``verified`` gives for all pairs of ``candidates``: first of the ``nearest`` ones of each class, then of all others of those that these leave open.

    One earlier class is enough for a line to go, so a group of near copies is settled by a few pairs a class.
    """
    texts = words_of_classes(docs, sets, pairs, broadcast_rows)
    order = Window.partitionBy(F.coalesce("asks", "x")).orderBy("far", "x", "y")
    ranked = stored(pairs.withColumn("turn", F.when(F.col("asks").isNull(), 0).otherwise(F.row_number().over(order))))
    near = stored(verified(ranked.where(F.col("turn") <= nearest).select("x", "y"), texts))
    done = few(near.select(F.col("id").alias("asks")), broadcast_rows)
    rest = stored(verified(ranked.where(F.col("turn") > nearest).join(done, "asks", "left_anti").select("x", "y"), texts))
    discard(texts, ranked)
    return [near, rest]


def kept_lines(docs: DataFrame, bits: int = BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, ``line_no`` of the lines that stay, lines without tokens aside.

    A line goes if any earlier one (by doc_id, then place) has a Jaccard of 0.8
    or more with it, as sets of lower-case tokens; an earlier line counts
    whether or not it stays itself. Rows of the same doc_id count as one
    document, and lines at the same place of it don't remove each other; a null
    doc_id comes first. Null and empty texts have no lines to lose, an empty table none at all.
    """
    docs = docs.select("doc_id", "text")
    cut = held(docs)
    sets = classes_of(cut, bits)
    leads = leading(sets, GROUP, broadcast_rows)
    texts = words_of_classes(docs, sets, leads, broadcast_rows, cut)
    cut.unpersist(blocking=True)
    settled = stored(verified(leads, texts))
    discard(leads, texts)
    pairs = stored(candidates(sets, few(settled.select("id"), broadcast_rows)))
    near, rest = settled_by(docs, sets, pairs, broadcast_rows)
    discard(pairs)
    gone = few(settled.union(near).union(rest).select(F.col("doc_id").alias("_d"), F.col("line_no").alias("_l")), broadcast_rows)
    return sets.select("doc_id", "line_no").join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("line_no") == F.col("_l")), "left_anti")


def _numbers(docs: DataFrame, carried: Column, **how) -> DataFrame:
    """``own`` (what of a row is carried along), ``n_lines`` and the numbers ``kept`` of the lines that stay, made before texts would be shuffled."""
    due = kept_lines(docs, **how).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("line_no").alias("due"))
    cut = F.split("text", "\n")
    bare = F.array_compact(F.transform(cut, lambda line, i: F.when(~line.rlike(r"[\p{L}\p{N}]"), i)))
    rows = docs.select(carried.alias("own"), F.col("doc_id").alias("_id"), F.size(cut).alias("n_lines"), bare.alias("bare"))
    none = F.array().cast("array<int>")
    both = F.concat(F.coalesce("due", none), F.coalesce("bare", none))
    rows = rows.join(due, F.col("_id").eqNullSafe(F.col("_doc")), "left")
    return rows.select("own", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.array_sort(F.array_distinct(both)).alias("kept"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the texts of the lines that stay; a document without any has an empty text, a null stays null.

    Columns are unchanged, whatever their names.
    """
    rows = _numbers(docs, F.struct("*"), **how).select("own", "kept", F.split("own.text", "\n").alias("cut"))
    text = F.when(F.col("own.text").isNotNull(), F.array_join(F.array_compact(F.transform("kept", lambda i: F.get("cut", i))), "\n"))
    return rows.select(F.col("own").withField("text", text).alias("own")).select("own.*")


def op4_line_join(spark, sf_dir: str) -> DataFrame:
    """For every document its number of lines and the numbers of those that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _numbers(docs, F.struct("doc_id"))
    return rows.select("own.doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", ",").alias("kept"))


ORACLE = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS words FROM l),
    c AS (SELECT words, min((doc_id, line_no)) AS spot, row_number() OVER () AS id, len(words) AS n FROM w WHERE len(words) > 0 GROUP BY words),
    t AS (SELECT id, n, spot, unnest(words) AS word FROM c WHERE n > 3),
    gone AS (SELECT b.id FROM t a JOIN t b ON a.word = b.word AND a.spot < b.spot AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
        GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 9 >= (a.n + b.n) * 4),
    k AS (SELECT spot[1] AS doc_id, spot[2] AS line_no FROM c WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT doc_id, line_no FROM w WHERE len(words) = 0)
    SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(kept), 0) AS BIGINT) AS n_kept,
    coalesce(array_to_string(kept, ','), '') AS kept
    FROM documents d LEFT JOIN (SELECT doc_id, list_sort(list(line_no)) AS kept FROM k GROUP BY doc_id) k ON d.doc_id = k.doc_id"""
