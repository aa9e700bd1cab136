"""Near copies of whole documents: SimHash links, completed by an exact join of word shingles.

SimHash alone can't serve a Jaccard of 0.8: such texts lie some 10 of 64 bits apart, and up to 17,
where segments of at most one unlike bit are too short to tell texts apart. So SimHash finds
the close copies, and what it leaves is found by shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import discard, few, numbered, stored
from millrace.llm.components import components
from millrace.llm.line_dedup import BITS, BROADCAST_ROWS, DOWN, SHORT, UP, _alike
from millrace.llm.simhash import links

#: Words of a shingle, and bits of a fingerprint that SimHash links may differ by.
WORDS, DISTANCE = 5, 3
#: Classes of a component that count as many: within one of more, no pairs are made.
MANY = 64
#: Bits of the signature that sifts pairs, a power of two.
WIDE = 1024
#: Least hashes under so many orders, of which a class and the first of its bucket must share AGREE to be compared.
ORDERS, AGREE = 8, 4
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(ORDERS)], dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of a text's word shingles; words as in ``simhash.fingerprint``.

    Fewer words than a shingle make one shingle, none give none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _print(s: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def _sketched(rows: DataFrame, words: int, bits: int) -> DataFrame:
    """``id``, ``n``, ``fp`` and ``low`` (least hashes) of each row's shingle set; other rows (null ``id``) hold how many shingles of a task fall to a ``slot``."""
    order = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column("text")]
            ids, lows = [], []
            for s in sets:
                np.add.at(counts, s >> np.uint64(64 - bits), 1)
                ids.append(xxhash.xxh64_intdigest(s.tobytes()))
                lows.append([int((s * odd).min()) >> 1 for odd in _ODD] if len(s) else [])
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in order], pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(list(map(len, sets)), pa.int64()),
                 pa.array(list(map(_print, sets)), pa.int64()), pa.array(lows, pa.list_(pa.int64())), none, none], names)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            empty = [pa.nulls(len(some), f) for f in kinds]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(some), pa.array(counts[some])], names)

    own = "id long, n long, fp long, low array<long>, slot long, count long"
    schema = rows.select(*order).schema
    for field in rows.sparkSession.createDataFrame([], own).schema:
        schema = schema.add(field)
    for field in schema:
        field.nullable = True
    arrow = to_arrow_schema(schema)
    names, kinds = arrow.names, arrow.types[:-2]
    return rows.mapInArrow(run, schema)


def _prefixed(rows: DataFrame, counts: np.ndarray, words: int, bits: int) -> DataFrame:
    """``_file``, ``_row``, ``prefix`` of rarity codes, ``s0`` and ``s1`` (as in ``line_dedup``) and ``wide``, a signature of WIDE bits, of each row's text."""
    # by the slots' ranks, which tell a passage of some dozen copies from the chance counts of a slot
    levels = (np.argsort(np.argsort(counts, kind="stable"), kind="stable") * 127 // len(counts)).astype(np.uint8)
    rare = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, sig, wide = [], np.zeros((batch.num_rows, 2), np.uint64), np.zeros((batch.num_rows, WIDE // 64), np.uint64)
            for k, t in enumerate(batch.column("text")):
                s = shingles(t.as_py(), words)
                code = (rare.value[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                odd = np.bincount((code & np.uint64(127 if len(s) > SHORT else 63)).astype(np.int64), minlength=128) & 1
                sig[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
                odd = np.bincount((code & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1
                wide[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
                keep = len(s) - -(-len(s) * UP // DOWN) + 1 if len(s) else 0
                prefix.append(np.sort(code)[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_file"), batch.column("_row"), pa.array(prefix, pa.list_(pa.int64())), *(pa.array(sig[:, i].copy().view(np.int64)) for i in (0, 1)),
                 pa.array(list(wide.view(np.int64)), pa.list_(pa.int64()))], ["_file", "_row", "prefix", "s0", "s1", "wide"])

    return rows.select("_file", "_row", "text").mapInArrow(run, "_file long, _row long, prefix array<long>, s0 long, s1 long, wide array<long>")


def _hashed(rows: DataFrame, words: int) -> DataFrame:
    """``id`` and all hashes of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                sets = [shingles(t.as_py(), words).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "w"])

    return rows.select("id", "text").mapInArrow(run, "id long, w array<long>")


def _leading(sets: DataFrame) -> DataFrame:
    """Pairs of a class and the first one of the same least hash, by each order, if AGREE of the orders agree.

    At most ORDERS pairs a class: settles most members of a large group of near copies.
    """
    rows = sets.where("n > 3").select("id", "n", "o", "low", F.posexplode("low").alias("j", "key"))
    first = rows.groupBy("j", "key").agg(F.min(F.struct("o", "id", "n", "low")).alias("f"), F.count("*").alias("k")).where("k > 1").drop("k")
    same = F.size(F.filter(F.zip_with("low", "f.low", lambda a, b: a == b), lambda x: x)) >= AGREE
    sized = (F.col("n") * DOWN >= F.col("f.n") * UP) & (F.col("f.n") * DOWN >= F.col("n") * UP)
    return rows.join(first, ["j", "key"]).where((F.col("f.o") < F.col("o")) & same & sized).select(F.col("f.id").alias("x"), F.col("id").alias("y")).distinct()


def _crossing(codes: DataFrame) -> DataFrame:
    """Pairs ``x`` < ``y`` of classes of unlike ``comp`` that pass the prefix, length, positional and signature filters.

    In each code, the classes of the component that has the most there (of those of over MANY classes) are only
    looked up, and don't look up, as they could find but each other. So a large component makes no pairs within.
    Of two that both look up, the greater one does.
    """
    rows = codes.where("n > 3").select("id", "comp", "many", "s0", "s1", F.col("n").cast("long").alias("n"), F.posexplode("prefix").alias("i", "code"))
    most = rows.where("many").groupBy("code", "comp").agg(F.count("*").alias("k")).groupBy("code").agg(F.max(F.struct("k", "comp"))["comp"].alias("most"))
    cols = ["code", "id", "comp", "s0", "s1"]
    state = F.shiftleft("n", 32) + F.col("i")
    single = rows.where("NOT many").select(*cols, state.alias("m"))
    # one long holds the size, whether the class is only looked up and the code's place
    passive = F.when(F.col("comp") == F.col("most"), 1 << 31).otherwise(0)
    large = rows.where("many").join(most, "code").select(*cols, (state + passive).alias("m"))
    found = F.col("m").bitwiseAND(F.lit(1 << 31)) == 0
    size, place = F.shiftright("m", 32), F.col("m").bitwiseAND(F.lit((1 << 31) - 1))
    index = lambda n, i: (n - i) * (UP + DOWN) >= n * 2 * UP
    # the smaller set of a pair is looked up by its index prefix only
    a = single.union(large).where(~found | index(size, place)).toDF("code", "x", "c1", "a0", "a1", "m1")
    b = single.union(large.where(found)).toDF("code", "y", "c2", "b0", "b1", "m2")
    n1, n2 = F.shiftright("m1", 32), F.shiftright("m2", 32)
    once = (F.col("m1").bitwiseAND(F.lit(1 << 31)) != 0) | (n1 < n2) | ((n1 == n2) & (F.col("x") < F.col("y")))
    i1, i2 = F.col("m1").bitwiseAND(F.lit((1 << 31) - 1)), F.col("m2").bitwiseAND(F.lit((1 << 31) - 1))
    placed = F.least(n1 - i1, n2 - i2) * (UP + DOWN) >= (n1 + n2) * UP
    placed &= F.when(n1 <= n2, index(n1, i1)).otherwise(index(n2, i2))
    alike = _alike(n1, (F.col("a0"), F.col("a1")), n2, (F.col("b0"), F.col("b1")))
    pairs = a.join(b, "code").where((F.col("c1") != F.col("c2")) & once & placed & alike)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _sifted(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs whose wide signatures allow the threshold: those of texts of some thousand words are told apart without their shingles."""
    own = codes.select("id", "n", "wide")
    rows = pairs.join(own.toDF("x", "n1", "w1"), "x").join(own.toDF("y", "n2", "w2"), "y")
    unlike = F.aggregate(F.zip_with("w1", "w2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    return rows.where(unlike * (UP + DOWN) <= (F.col("n1") + F.col("n2")) * (DOWN - UP)).select("x", "y")


def _true(rows: DataFrame, sets: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs ``x``, ``y`` of classes whose shingles reach the threshold; texts of these classes alone are read again."""
    ids = few(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), BROADCAST_ROWS)
    wanted = sets.join(ids, "id", "left_semi").select("id", "o._file", "o._row")
    texts = _hashed(rows.join(few(wanted, BROADCAST_ROWS), ["_file", "_row"]), words)
    a, b = texts.toDF("x", "w1"), texts.toDF("y", "w2")
    alike = F.size(F.array_intersect("w1", "w2")) * (UP + DOWN) >= (F.size("w1") + F.size("w2")) * UP
    return pairs.join(a, "x").join(b, "y").where(alike).select("x", "y")


def _grouped(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with ``comp``, the component's least id."""
    return sets.join(components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def drop_copies(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies; columns unchanged, whatever their names.

    Near copies have a Jaccard of 0.8 or more as sets of word shingles, which is
    computed of the texts; groups are what such pairs connect. The row of the least doc_id (null last) stays, and of
    equal ones the first in the files. Null and blank texts are copies of each other, repeated rows too.

    Rows of the same set are one class. Classes are linked by their SimHash within ``distance`` bits (see
    ``simhash.links``) and with the first ones that share a least hash, and verified. Then each is compared with all classes
    of other components that share a code of its prefix (the rarest fifth of its shingles), which loses no pair.
    """
    rows = numbered(docs).select("_file", "_row", "own", F.col("own.text").alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
    sketched = stored(_sketched(rows.select("own.doc_id", "_file", "_row", "text"), words, bits))
    counts = np.zeros(1 << bits, np.int64)
    # as many rows as there are slots, whatever the input
    for r in sketched.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("count").alias("count")).toArrow().to_batches():
        counts[np.asarray(r["slot"])] = np.asarray(r["count"])
    firsts = sketched.where("slot IS NULL").withColumn("o", order).groupBy("id").agg(F.min("o").alias("o"), *[F.first(c).alias(c) for c in ("n", "fp", "low")])
    sets = stored(firsts)
    discard(sketched)
    near = links(sets.where("n > 3").select("id", "fp"), distance).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    lead = _leading(sets).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    close = stored(near.union(lead).distinct())
    found = stored(_true(rows, sets, close, words))
    discard(close)
    joined = stored(_grouped(sets.select("id", "n", "o"), found))
    sizes = joined.groupBy("comp").agg((F.count("*") > MANY).alias("many")).where("many")
    of = joined.where("n > 3").select("id", F.col("n").cast("int").alias("n"), "comp", "o._file", "o._row").join(sizes, "comp", "left")
    of = of.select("id", "n", "comp", F.coalesce("many", F.lit(False)).alias("many"), "_file", "_row")
    # made of all rows, as most are the first of their class, so that prefixes are shuffled and not texts
    prefixed = _prefixed(rows, counts, words, bits)
    codes = stored(prefixed.join(few(of, BROADCAST_ROWS), ["_file", "_row"]).drop("_file", "_row"))
    crossing = stored(_crossing(codes))
    pairs = stored(_sifted(crossing, codes))
    discard(codes, crossing)
    more = _true(rows, sets, pairs, words)
    root = joined.select("id", "comp")
    across = more.join(root.toDF("x", "a"), "x").join(root.toDF("y", "b"), "y").select("a", "b")
    final = components(across)
    top = joined.join(final.select(F.col("id").alias("comp"), F.col("root").alias("top")), "comp", "left").withColumn("top", F.coalesce("top", "comp"))
    kept = top.groupBy("top").agg(F.min("o").alias("o")).select("o._file", "o._row")
    return rows.join(kept, ["_file", "_row"], "left_semi").select("own.*")
