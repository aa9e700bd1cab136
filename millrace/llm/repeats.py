"""Suffix-array dedup: bytes of passages that occur more than once, by passes over suffixes at chosen places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.keyed import key_groups

#: Window starts worked on at a time, so that a very long text takes little memory.
CHUNK = 1 << 18
#: Classes of one gram, and contexts of one gram, that a task holds; more are worked on by shuffled aggregates.
LARGE, CONTEXTS = 200_000, 100_000
#: Hashes of windows that a task holds at a time (13 MB).
HELD = 1 << 21

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2^64."""
    if n not in _POWERS:
        up, down = (np.full(n, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width``, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    n = len(x) - width + 1
    return pick(out[:n], out[width - size : width - size + n])


def anchors(text: bytes, depth: int, gram: int) -> list[np.ndarray]:
    """Places of anchors, with the hashes of their gram, left part and right part, and the parts' lengths.

    An anchor is a gram whose hash is least in some window of ``depth`` bytes.
    So every window holds one, at a place that its bytes alone determine. The left
    part is the gram with up to depth - gram bytes before it, the right part with as many after.
    """
    n, room = len(text), depth - gram
    if n < depth:
        return [np.empty(0, dtype=np.int64)] * 6
    up, down = _powers(CHUNK + 4 * depth)
    out = []
    for first in range(0, n - depth + 1, CHUNK):
        lo, hi = max(0, first - room), min(n, first + CHUNK + 2 * depth)
        raw = _BYTE[np.frombuffer(text, dtype=np.uint8, count=hi - lo, offset=lo)]
        total = np.empty(len(raw) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(raw * up[: len(raw)], out=total[1:])
        starts = np.arange(first - lo, min(first + CHUNK, n - depth + 1) - lo)
        grams = slice(starts[0], starts[-1] + room + 1)
        h = (total[grams.start + gram : grams.stop + gram] - total[grams]) * down[grams]
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0x7FB5D329728EA185) >> np.uint64(32)).astype(np.uint32)
        least = _slide(h, room + 1, np.minimum)
        edge = np.zeros(room, dtype=np.uint32)
        at = np.flatnonzero(_slide(np.concatenate((edge, least, edge)), room + 1, np.maximum) == h) + grams.start
        left, right = np.minimum(room, at + lo), np.minimum(room, n - (at + lo) - gram)
        part = lambda a, b: _mix((total[b] - total[a]) * down[a])
        out.append((at + lo, part(at, at + gram), part(at - left, at + gram), part(at, at + gram + right), left, right))
    if len(out) == 1:
        return list(out[0])
    joined = [np.concatenate(x) for x in zip(*out, strict=True)]
    _, one = np.unique(joined[0], return_index=True)
    return [x[one] for x in joined]


def _anchor_rows(depth: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = np.asarray(batch.column("dk")), []
            for k, text in zip(keys, batch.column("text"), strict=True):
                at, g, kl, kr, left, right = anchors(text.as_py().encode("utf-8", "surrogatepass"), depth, gram)
                if len(at):
                    # the parts' lengths go with the place: 24 bits each would hold any depth up to 4096 in 12
                    rows.append((np.full(len(at), k), (at << 24) | (left << 12) | right, *(x.view(np.int64) for x in (g, kl, kr))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["dk", "p", "g", "kl", "kr"])

    return run


def _parts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 24, (p >> 12) & 4095, p & 4095


def _often(*keys: np.ndarray) -> np.ndarray:
    """Whether a row's keys occur in another row too."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    new[:1] = True
    run = np.cumsum(new) - 1
    out = np.empty(len(order), dtype=bool)
    out[order] = np.bincount(run)[run] > 1
    return out


#: What the first pass says of a class of equal contexts: all that it spans is repeated; it is to be compared, and its
#: span asked for; it is to be compared only; its gram has too many classes for one task.
WHOLE, ASK, PARTNER, CROWDED = 0, 1, 2, 3


def _ends(room: int, large: int):
    """The first pass: classes of equal grams are refined by the longest left and right parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for crowded, (g, dk, p, kl, kr, n) in key_groups(batches, "g", ["g", "dk", "p", "kl", "kr", "n"], large):
            if crowded:
                state = np.full(len(g), CROWDED)
            else:
                starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
                keep = np.bincount(group, weights=n)[group] > 1
                g, dk, p, kl, kr, n, group = (x[keep] for x in (g, dk, p, kl, kr, n, group))
                if not len(g):
                    continue
                _, left, right = _parts(p)
                full = _often(g, kl, left == room) & (left == room) & _often(g, kr, right == room) & (right == room)
                ask = ~((n > 1) | full)
                state = np.where(ask, ASK, WHOLE)
                # where some class of the gram is asked for, it is compared with all the others too
                partner = (np.bincount(group, weights=ask)[group] > 0) & ~ask
                g, dk, p, kl, kr, n = (np.concatenate((x, x[partner])) for x in (g, dk, p, kl, kr, n))
                state = np.concatenate((state, np.full(int(partner.sum()), PARTNER)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, dk, p, kl, kr, n, state.astype(np.int32))], ["g", "dk", "p", "kl", "kr", "n", "state"])

    return run


def _context_rows(depth: int, gram: int):
    """Bytes around the anchors asked for: (g, dk, p, state, ctx)."""
    room = depth - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dk, text, asked in zip(batch.column("dk"), batch.column("text"), batch.column("asked"), strict=True):
                raw, rows = text.as_py().encode("utf-8", "surrogatepass"), asked.as_py()
                for i in range(0, len(rows), 4096):
                    some = rows[i : i + 4096]
                    ctx = [raw[max(0, (r["p"] >> 24) - room) : (r["p"] >> 24) + depth] for r in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["g"] for r in some], pa.int64()), pa.array([dk.as_py()] * len(some), pa.int64()), pa.array([r["p"] for r in some], pa.int64()),
                         pa.array([r["state"] for r in some], pa.int32()), pa.array(ctx, pa.binary())], ["g", "dk", "p", "state", "ctx"])

    return run


def _window_hashes(g: np.ndarray, p: np.ndarray, ctx: np.ndarray, depth: int, gram: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the gram and each window that holds it, for the starts ``c`` (a run) of windows before the gram; and which windows there are."""
    room = depth - gram
    _, left, right = _parts(p)
    wide = depth + room
    up, down = _powers(CHUNK + 4 * depth)
    hashes, there = np.empty((len(g), len(c)), dtype=np.uint64), np.empty((len(g), len(c)), dtype=bool)
    for i in range(0, len(g), 2048):
        rows = slice(i, min(i + 2048, len(g)))
        flat = b"".join(b"\0" * (room - int(a)) + x + b"\0" * (room - int(b)) for a, b, x in zip(left[rows], right[rows], ctx[rows], strict=True))
        raw = _BYTE[np.frombuffer(flat, dtype=np.uint8).reshape(-1, wide)]
        total = np.zeros((len(raw), wide + 1), dtype=np.uint64)
        np.cumsum(raw * up[:wide], axis=1, out=total[:, 1:])
        h = _mix((total[:, depth + c[0] : depth + c[-1] + 1] - total[:, c[0] : c[-1] + 1]) * down[c])
        hashes[rows] = _mix(h + g[rows].view(np.uint64)[:, None] * np.uint64(_BASE) + c.astype(np.uint64) * np.uint64(0x81DADEF4BC2DD44D))
        there[rows] = (c >= room - left[rows, None]) & (c <= right[rows, None])
    return hashes, there


def _spans(dk, p, found, depth: int, room: int) -> list[np.ndarray]:
    """Spans from the first to the last window found of each row that has any."""
    hit = found.any(axis=1)
    first, last = found[hit].argmax(axis=1), found.shape[1] - 1 - found[hit][:, ::-1].argmax(axis=1)
    at = (p[hit] >> 24) - room
    return [dk[hit], at + first, at + last + depth]


def _edges(depth: int, gram: int, large: int):
    """The last pass: windows around anchors at the edges of repeated passages; equal hashes are equal windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for crowded, (g, dk, p, state, ctx) in key_groups(batches, "g", ["g", "dk", "p", "state", "ctx"], large):
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (dk, p, p)] + [pa.array(g)], ["dk", "a", "b", "g"])
                continue
            ends = np.flatnonzero(np.r_[g[1:] != g[:-1], True]) + 1
            lo = 0
            while lo < len(g):  # some whole groups at a time
                hi = int(ends[max(np.searchsorted(ends, lo + 8192, "right") - 1, np.searchsorted(ends, lo, "right"))])
                ask = state[lo:hi] == ASK
                found = np.zeros((int(ask.sum()), depth - gram + 1), dtype=bool)
                # equal windows start at the same place before the gram: a large group is worked on by some places at a time
                step = max(1, HELD // (hi - lo))
                for first in range(0, found.shape[1] if len(found) else 0, step):
                    c = np.arange(first, min(first + step, found.shape[1]))
                    hashes, there = _window_hashes(g[lo:hi], p[lo:hi], ctx[lo:hi], depth, gram, c)
                    order = np.sort(hashes[there])
                    twice = order[1:][order[1:] == order[:-1]]
                    twice = twice[np.r_[True, twice[1:] != twice[:-1]]] if len(twice) else twice
                    if len(twice):
                        asked = hashes[ask]
                        spot = np.minimum(np.searchsorted(twice, asked), len(twice) - 1)
                        found[:, c] = there[ask] & (twice[spot] == asked)
                rows = _spans(dk[lo:hi][ask], p[lo:hi][ask], found, depth, depth - gram)
                if len(rows[0]):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(len(rows[0]), pa.int64())], ["dk", "a", "b", "g"])
                lo = hi

    return run


def _window_rows(depth: int, gram: int):
    """The windows of anchors of a gram that is too frequent, a row each: (h, dk, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, dk, p = (np.asarray(batch.column(c)) for c in ("g", "dk", "p"))
            ctx = np.array([*batch.column("ctx").to_pylist(), None], dtype=object)[:-1]
            for i in range(0, len(g), 2048):
                s = slice(i, i + 2048)
                hashes, there = _window_hashes(g[s], p[s], ctx[s], depth, gram, np.arange(depth - gram + 1))
                row, c = np.nonzero(there)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[there].view(np.int64)), pa.array(dk[s][row]), pa.array((p[s][row] >> 24) - (depth - gram) + c)], ["h", "dk", "a"])

    return run


def _text_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))


def _contexts(docs: DataFrame, asked: DataFrame, depth: int, gram: int) -> DataFrame:
    by_doc = asked.groupBy("dk").agg(F.collect_list(F.struct("g", "p", "state")).alias("asked"))
    texts = docs.where(F.octet_length("text") >= depth).select(_text_key().alias("dk"), "text")
    return texts.join(by_doc, "dk").mapInArrow(_context_rows(depth, gram), "g long, dk long, p long, state int, ctx binary")


def _by_windows(contexts: DataFrame, depth: int, gram: int) -> DataFrame:
    """Spans of anchors of too frequent grams: every window is counted, by partial sums before the shuffle."""
    rows = stored(contexts.mapInArrow(_window_rows(depth, gram), "h long, dk long, a long"))
    # a window of a repeated document counts once here, so its own copies were told apart before
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return rows.join(often, "h").select("dk", "a", (F.col("a") + depth).alias("b"))


def repeated_spans(docs: DataFrame, depth: int = 400, gram: int | None = None, large: int = LARGE, contexts: int = CONTEXTS) -> DataFrame:
    """``dk`` (the document's key) and spans [``a``, ``b``) of bytes whose union is what repeated windows cover.

    A suffix array cut off at ``depth`` bytes groups equal windows; ordering all
    suffixes would shuffle ``depth`` bytes for each byte. Here suffixes
    are first thinned: an anchor (see ``anchors``) lies in every window, at
    one in about ``(depth - gram) / 2`` bytes, at a place given by the window's
    content, so equal windows have equal anchors. The radix passes then refine groups
    of anchors, most significant digit first, and drop what stands alone:
    the gram; the longest part to its left and to its right; and, only at the edges
    of passages, each single window. Groups that remain are the repeated windows. Digits are compared as
    64-bit hashes within groups of equal grams.

    Anchors of equal gram, parts and lengths are one class, which is counted before the shuffle, so many copies of a
    passage are a few classes. A gram of over ``large`` classes, or ``contexts`` edges, isn't held by
    one task: its windows are counted by a shuffled aggregate. ``depth - gram`` is at most 4,095.
    """
    gram = depth // 2 if gram is None else gram
    room = depth - gram
    if not 0 < gram < depth or room > 4095:
        raise ValueError("depth must exceed gram, and by at most 4,095")
    docs = docs.select("doc_id", "text")
    long_ = docs.where(F.octet_length("text") >= depth).select(_text_key().alias("dk"), "text")
    digits = ["g", "kl", "kr", "size"]
    rows = stored(long_.mapInArrow(_anchor_rows(depth, gram), "dk long, p long, g long, kl long, kr long").withColumn("size", F.col("p").bitwiseAND(F.lit((1 << 24) - 1))))
    same = rows.groupBy(*digits).agg(F.count("*").alias("n"), F.first("dk").alias("dk"), F.first("p").alias("p"))
    ends = same.select("g", "dk", "p", "kl", "kr", "n").repartition("g").sortWithinPartitions("g")
    ends = stored(ends.mapInArrow(_ends(room, large), "g long, dk long, p long, kl long, kr long, n long, state int"))
    left, right = F.shiftright("p", 12).bitwiseAND(F.lit(4095)), F.col("p").bitwiseAND(F.lit(4095))
    span = [F.col("dk"), (F.shiftright("p", 24) - left).alias("a"), (F.shiftright("p", 24) + gram + right).alias("b")]
    out = ends.where((F.col("state") == WHOLE) & (F.col("n") == 1)).select(*span)
    many = ends.where((F.col("state").isin(WHOLE, CROWDED)) & (F.col("n") > 1)).withColumn("size", F.col("p").bitwiseAND(F.lit((1 << 24) - 1)))
    out = out.union(rows.join(many.select(*digits), digits, "left_semi").select(*span))
    asked = ends.where(F.col("state").isin(ASK, PARTNER)).select("g", "dk", "p", "state")
    crowded = ends.where(F.col("state") == CROWDED).select("g", "dk", "p", F.lit(ASK).alias("state"))
    if crowded.limit(1).count():
        out = out.union(_by_windows(_contexts(docs, crowded, depth, gram), depth, gram))
    ctx = _contexts(docs, asked, depth, gram).repartition("g").sortWithinPartitions("g")
    found = stored(ctx.mapInArrow(_edges(depth, gram, contexts), "dk long, a long, b long, g long"))
    out = out.union(found.where("g IS NULL").select("dk", "a", "b"))
    rest = found.where("g IS NOT NULL")
    if rest.limit(1).count():
        again = asked.join(rest.select("g").distinct(), "g", "left_semi")
        out = out.union(_by_windows(_contexts(docs, again, depth, gram), depth, gram))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [[], [], [], []]
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for s in sorted((s["a"], s["b"]) for s in spans.as_py() or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            bounds = [0, *(x for r in runs for x in r), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            for col, x in zip(cols, (len(raw), len(raw) - len(kept), len(runs), kept), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in cols[3]], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, depth: int = 400, kept: bool = True, **how) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) and ``kept_sha256`` of every row.

    A byte is removed if a string of ``depth`` bytes that also starts anywhere
    else covers it. Nulls count as empty; shorter texts lose nothing to others; repeated rows are
    documents of their own and so repeats of each other. A removal may split a UTF-8
    character, so what is kept is binary. Other columns of ``docs`` don't matter.
    """
    spans = repeated_spans(docs, depth, **how).groupBy("dk").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = docs.select("doc_id", "text", _text_key().alias("_dk")).join(spans, F.col("_dk") == F.col("dk"), "left")
    out = rows.select("doc_id", "text", "spans").mapInArrow(
        _cut, docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary").add("kept_sha256", "string")
    )
    return out if kept else out.drop("kept")


def op7_suffix_radix(spark, sf_dir: str) -> DataFrame:
    """All documents at 400 bytes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 400, kept=False)
