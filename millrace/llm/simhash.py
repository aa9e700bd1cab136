"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered, stored
from millrace.llm.components import components
from millrace.llm.keyed import key_groups

#: Shingles hashed at a time, so that a very long text takes little memory.
CHUNK = 1 << 16
#: A bucket of up to SMALL members is compared pair by pair, of up to LARGE by a search; a larger one is cut into blocks.
SMALL, LARGE = 24, 4096


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included.

    A-Z is lower-cased; words end at ASCII white space; fewer words than a shingle
    make one shingle; none give 0. A bit is 1 if it is set in over half of the
    shingles' XXH64.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = ends - [len(t) for t in tokens]
    if len(tokens) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), CHUNK):
        cut = map(slice, starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist())
        h = np.array(list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(seed))), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Adds nothing but ``fp`` (the 64 bits as a signed long) to all columns other than ``text``, which goes."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(fp)], [*rest, "fp"])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def segments(bits: int, count: int) -> list[tuple[int, int]]:
    """First bit and width of each of ``count`` nearly equal segments."""
    cuts = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def needed_segments(distance: int) -> int:
    """The fewest segments of which one differs by at most one bit."""
    return distance // 2 + 1


def variants(nodes: DataFrame, distance: int) -> DataFrame:
    """One row for each segment and wildcard bit: ``key`` is the segment's number, the bit and the segment without it."""
    keys = []
    for s, (low, width) in enumerate(segments(64, needed_segments(distance))):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for j in range(width):
            keys.append(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j))) + F.lit((s * 64 + j) << 40))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "id", "fp")


def _pairs(key: np.ndarray, ids: np.ndarray, fp: np.ndarray, distance: int):
    """Linked pairs within runs of equal ``key``; each pair only in the first bucket that it shares."""
    cuts = segments(64, needed_segments(distance))
    at, off, out = np.arange(len(key)), 0, []
    while True:
        off += 1
        at = at[: np.searchsorted(at, len(key) - off)]
        at = at[key[at] == key[at + off]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + off]
        near = np.bitwise_count(x) <= distance
        hit, x = at[near], x[near]
        tag = key[hit].view(np.uint64) >> np.uint64(40)
        own, done = np.zeros(len(hit), dtype=bool), np.zeros(len(hit), dtype=bool)
        for s, (low, width) in enumerate(cuts):
            part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
            first = ~done & (np.bitwise_count(part) <= 1)
            bit = np.bitwise_count(np.maximum(part, np.uint64(1)) - np.uint64(1)).astype(np.uint64)
            own |= first & (tag == np.uint64(64 * s) + bit)
            done |= first
        out.append((ids[hit[own]], ids[hit[own] + off]))
    return out


def _forest(ids: np.ndarray, fp: np.ndarray, distance: int):
    """Links that join what is joined within one bucket: breadth first, each member compared with those not reached."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= distance
            if near.any():
                reached, left = left[near], left[~near]
                a.append(np.full(len(reached), ids[i])), b.append(ids[reached])
                todo += reached.tolist()
    return [(np.concatenate(a), np.concatenate(b))] if a else []


def _linker(distance: int, small: int, large: int):
    """For key-sorted partitions: rows (a, b, key); a is b and key is set for the members of a bucket that is too large."""

    def linked(key, ids, fp):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        few = np.repeat((sizes > 1) & (sizes <= small), sizes)
        out = _pairs(key[few], ids[few], fp[few], distance)
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            out += _forest(ids[s : s + n], fp[s : s + n], distance)
        return out

    def batch(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key, pa.int64(), from_pandas=True)], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for crowded, (key, ids, fp) in key_groups(batches, "key", ["key", "id", "fp"], large):
            if crowded:
                yield batch(ids, ids, key)
                continue
            for a, b in linked(key, ids, fp.view(np.uint64)):
                yield batch(a, b, np.full(len(a), None, dtype=object))

    return run


def _blocks(nodes: DataFrame, crowded: DataFrame, distance: int, size: int) -> DataFrame:
    """Links within buckets too large for a task: each is cut into blocks and each pair of blocks searched on its own."""
    counts = crowded.groupBy("key").agg(F.ceil(F.count("*") / size).alias("n"))
    rows = crowded.join(counts, "key").join(nodes, F.col("a") == F.col("id")).select("key", "id", "fp", "n")
    rows = rows.withColumn("x", F.pmod(F.xxhash64("id"), F.col("n"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "id", "fp")

    def run(part: pa.Table) -> pa.Table:
        got = _forest(np.asarray(part["id"]), np.asarray(part["fp"]).view(np.uint64), distance)
        a, b = got[0] if got else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"a": a, "b": b})

    return rows.groupBy("key").applyInArrow(run, "a long, b long")


def links(nodes: DataFrame, distance: int = 2, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Links (a, b) that join all ``id`` whose ``fp`` are at most ``distance`` bits apart.

    Of a cluster not every pair is returned, but what is connected stays connected and every
    link returned is a true one. The fingerprint is cut into ``distance // 2 + 1``
    segments, of which one differs by at most one bit; so two near fingerprints
    share the variant of that segment in which the bit is a wildcard. Variants are
    joined by equality and verified. With n fingerprints a bucket of a w-bit
    segment holds about n / 2^(w-1) by chance: 32-bit segments (distances 2 and 3)
    serve 10^9 and more, 21-bit ones (4 and 5) some 10^7.

    Buckets over ``large`` members aren't held by one task: they are cut into
    blocks of that size, and pairs of blocks are searched apart.
    """
    found = stored(
        variants(nodes, distance).repartition("key").sortWithinPartitions("key").mapInArrow(_linker(distance, small, large), "a long, b long, key long")
    )
    crowded = found.where("key IS NOT NULL")
    out = found.where("key IS NULL").select("a", "b")
    if crowded.limit(1).count():
        out = out.union(_blocks(nodes, crowded, distance, large))
    return out


def near_groups(docs: DataFrame, words: int = 3, distance: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` and the columns in ``keep``. The component's id is the least doc_id reachable over links between near fingerprints.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows
    with a null id link but never name a component, unless it has no id at all
    (then null). Equal ids with unlike texts each keep their own row. An empty table gives an empty table.
    """
    keep = keep or []
    prints = stored(fingerprints(docs.select("doc_id", "text", *keep), words))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select(F.col("fp").alias("id"), "fp"), distance))
    grouped = nodes.join(roots, nodes["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = grouped.join(least, "root").select("fp", "component_id", "root")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", *keep, *(["root"] if keep else []))


def drop_near(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (of repeated ones, the first in the files).

    Columns are unchanged, whatever their names; texts are shuffled once. Null and blank texts are one component.
    """
    rows = numbered(docs)
    groups = near_groups(rows.select("own.doc_id", "own.text", "_file", "_row"), keep=["_file", "_row"], **how)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_file", "_row")).alias("one")
    ones = groups.groupBy("root").agg(first).select("one._file", "one._row")
    return rows.join(ones, ["_file", "_row"], "left_semi").select("own.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at 2 bits."""
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
