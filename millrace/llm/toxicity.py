"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored
from millrace.llm.language import held_out, letters

#: Labelled documents that are learned from at most, the first by a hash, and the rank of the interactions.
TRAIN_DOCS, RANK = 12_000, 6
#: A term is learned if so many documents of the sample have it: the most telling ones, at most so many, and the most
#: frequent ones, which may tell something only together.
LEAST_DOCS, TERMS, COMMON = 3, 30_000, 1_000
THRESHOLD = 0.3


def term(word: str) -> int:
    """A word's hash, 48 bits."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 16


def words(text: str | None) -> set[str]:
    """The text's terms: its words, and the beginnings of 3 to 5 letters that longer words share (marked by a star)."""
    out = set(letters(text or ""))
    return out | {f"{w[:n]}*" for n in (3, 4, 5) for w in out if len(w) > n}


class Machine:
    """w0 + sum of w over the terms + sum over pairs of terms of <v, v'>, through a logistic function."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.row = {int(t): i for i, t in enumerate(terms)}
        self.w0, self.w, self.v = w0, w, v
        self.known: dict[str, int] = {}

    def score(self, text: str | None) -> float:
        """0 to 1; a text without learned terms scores what the intercept gives."""
        known, found = self.known, []
        for x in words(text):
            i = known.get(x)
            if i is None:
                i = self.row.get(term(x), -1)
                if len(known) >= 500_000:
                    known.clear()
                known[x] = i
            if i >= 0:
                found.append(i)
        i = np.array(sorted(found), dtype=np.int64)
        s = self.v[i].sum(axis=0)
        z = self.w0 + self.w[i].sum() + 0.5 * float((s * s).sum() - (self.v[i] ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0, epochs: int = 12, rate: float = 0.08, decay: float = 3e-5) -> Machine:
    """Learns by AdaGrad on the logistic loss, from bags of term hashes, a mini-batch a step.

    The terms kept are those of at least LEAST_DOCS bags that part the labels (by chi-square, above 3), or
    that are among the COMMON most frequent ones: a term may tell nothing by itself and much with another.
    The result depends on the bags and labels alone, not on their order.
    """
    keys = [(xxhash.xxh3_128_digest(np.ascontiguousarray(b).tobytes()), int(y)) for b, y in zip(bags, labels, strict=True)]
    order = sorted(range(len(bags)), key=keys.__getitem__)
    bags, labels = [bags[i] for i in order], np.asarray(labels, dtype=float)[order]
    n, pos = len(labels), labels.sum()
    if n == 0 or pos in (0, n):
        return Machine(np.empty(0), -3.0 if pos == 0 else 3.0, np.empty(0), np.empty((0, RANK)))
    flat, owner = np.concatenate(bags), np.repeat(np.arange(n), [len(b) for b in bags])
    ids, inverse = np.unique(flat, return_inverse=True)
    df = np.bincount(inverse, minlength=len(ids)).astype(float)
    hits = np.bincount(inverse, labels[owner], minlength=len(ids))
    expected = df * pos / n
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - pos / n) * np.maximum(1 - df / n, 1e-9), 1e-9)
    telling = np.flatnonzero((df >= LEAST_DOCS) & (chi > 3))
    common = np.flatnonzero(df >= LEAST_DOCS)
    chosen = np.union1d(telling[np.argsort(-chi[telling], kind="stable")[:TERMS]], common[np.argsort(-df[common], kind="stable")[:COMMON]])
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    used = place[inverse] >= 0
    col, own = place[inverse][used], owner[used]
    start = np.searchsorted(own, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), RANK)), float(np.log(pos / (n - pos)))
    gw, gv, g0 = np.full(len(chosen), 1e-3), np.full((len(chosen), RANK), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            rows = order[lo : lo + 64]
            sizes = start[rows + 1] - start[rows]
            c = np.concatenate([col[start[r] : start[r + 1]] for r in rows])
            k = np.repeat(np.arange(len(rows)), sizes)
            vc = v[c]
            s = np.zeros((len(rows), RANK))
            np.add.at(s, k, vc)
            square = np.bincount(k, (vc * vc).sum(axis=1), len(rows))
            z = w0 + np.bincount(k, w[c], len(rows)) + 0.5 * ((s * s).sum(axis=1) - square)
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]
            u, uk = np.unique(c, return_inverse=True)
            dw = np.bincount(uk, e[k], len(u)) + decay * len(rows) * w[u]
            dv = np.zeros((len(u), RANK))
            np.add.at(dv, uk, e[k, None] * (s[k] - vc))
            dv += decay * 10 * len(rows) * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += e.sum() ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= 0.3 * rate * dv / np.sqrt(gv[u])
            w0 -= rate * e.sum() / np.sqrt(g0)
    return Machine(ids[chosen], w0, w, v)


def _chosen(bags: DataFrame) -> np.ndarray:
    """The terms that ``fit`` will keep, counted over the sample by shuffled aggregates: at most TERMS + COMMON come to the driver."""
    n, pos = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not pos or pos == n:
        return np.empty(0, dtype=np.int64)
    counts = bags.select("toxic", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").cast("double").alias("df"), F.sum("toxic").alias("hits"))
    due = F.col("df") * float(pos) / float(n)
    spread = due * (1 - float(pos) / float(n)) * F.greatest(1 - F.col("df") / float(n), F.lit(1e-9))
    counts = stored(counts.where(F.col("df") >= LEAST_DOCS).withColumn("chi", (F.col("hits") - due) ** 2 / F.greatest(spread, F.lit(1e-9))))
    # a little more than ``fit`` takes, as its sums may differ in the last digit
    telling = counts.where("chi > 2.9").orderBy(F.desc("chi"), "t").limit(TERMS + 100).select("t")
    common = counts.orderBy(F.desc("df"), "t").limit(COMMON).select("t")
    out = np.array(sorted({r["t"] for r in telling.union(common).collect()}), dtype=np.int64)
    discard(counts)
    return out


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """A machine from about ``train_docs`` labelled documents that aren't held out.

    Terms are counted where the documents are; only those that are learned, as hashes, come to the driver, so what it
    holds is bounded by the sample and the number of terms, however long the texts. A document labelled twice is toxic if any
    label says so; rows of the same doc_id each count. The result doesn't depend on how rows are dealt or ordered.
    """
    toxic = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = toxic.count()
    if n > train_docs:
        share = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        toxic = toxic.where(share < train_docs / n)
    rows = docs.select("doc_id", "text").join(toxic, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [sorted(map(term, words(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bags, pa.list_(pa.int64()))], ["toxic", "terms"])

    bags = stored(rows.mapInArrow(hashed, "toxic int, terms array<long>"))
    kept = bags.sparkSession.sparkContext.broadcast(_chosen(bags))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [np.intersect1d(np.asarray(x.values, dtype=np.int64), kept.value) for x in batch.column("terms")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(few, pa.list_(pa.int64()))], ["toxic", "terms"])

    got = bags.mapInArrow(reduced, "toxic int, terms array<long>").toArrow()
    discard(bags)
    return fit([np.asarray(x.values, dtype=np.int64) for x in got["terms"]], np.asarray(got["toxic"]))


def score(self, text: str | None) -> float:
        """0 to 1; a text without learned terms scores what the intercept gives."""
        known, found = self.known, []
        for x in words(text):
            i = known.get(x)
            if i is None:
                i = self.row.get(term(x), -1)
                if len(known) >= 500_000:
                    known.clear()
                known[x] = i
            if i >= 0:
                found.append(i)
        i = np.array(sorted(found), dtype=np.int64)
        s = self.v[i].sum(axis=0)
        z = self.w0 + self.w[i].sum() + 0.5 * float((s * s).sum() - (self.v[i] ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0, epochs: int = 12, rate: float = 0.08, decay: float = 3e-5) -> Machine:
    """Learns by AdaGrad on the logistic loss, from bags of term hashes, a mini-batch a step.

    The terms kept are those of at least LEAST_DOCS bags that part the labels (by chi-square, above 3), or
    that are among the COMMON most frequent ones: a term may tell nothing by itself and much with another.
    The result depends on the bags and labels alone, not on their order.
    """
    keys = [(xxhash.xxh3_128_digest(np.ascontiguousarray(b).tobytes()), int(y)) for b, y in zip(bags, labels, strict=True)]
    order = sorted(range(len(bags)), key=keys.__getitem__)
    bags, labels = [bags[i] for i in order], np.asarray(labels, dtype=float)[order]
    n, pos = len(labels), labels.sum()
    if n == 0 or pos in (0, n):
        return Machine(np.empty(0), -3.0 if pos == 0 else 3.0, np.empty(0), np.empty((0, RANK)))
    flat, owner = np.concatenate(bags), np.repeat(np.arange(n), [len(b) for b in bags])
    ids, inverse = np.unique(flat, return_inverse=True)
    df = np.bincount(inverse, minlength=len(ids)).astype(float)
    hits = np.bincount(inverse, labels[owner], minlength=len(ids))
    expected = df * pos / n
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - pos / n) * np.maximum(1 - df / n, 1e-9), 1e-9)
    telling = np.flatnonzero((df >= LEAST_DOCS) & (chi > 3))
    common = np.flatnonzero(df >= LEAST_DOCS)
    chosen = np.union1d(telling[np.argsort(-chi[telling], kind="stable")[:TERMS]], common[np.argsort(-df[common], kind="stable")[:COMMON]])
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    used = place[inverse] >= 0
    col, own = place[inverse][used], owner[used]
    start = np.searchsorted(own, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), RANK)), float(np.log(pos / (n - pos)))
    gw, gv, g0 = np.full(len(chosen), 1e-3), np.full((len(chosen), RANK), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            rows = order[lo : lo + 64]
            sizes = start[rows + 1] - start[rows]
            c = np.concatenate([col[start[r] : start[r + 1]] for r in rows])
            k = np.repeat(np.arange(len(rows)), sizes)
            vc = v[c]
            s = np.zeros((len(rows), RANK))
            np.add.at(s, k, vc)
            square = np.bincount(k, (vc * vc).sum(axis=1), len(rows))
            z = w0 + np.bincount(k, w[c], len(rows)) + 0.5 * ((s * s).sum(axis=1) - square)
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]
            u, uk = np.unique(c, return_inverse=True)
            dw = np.bincount(uk, e[k], len(u)) + decay * len(rows) * w[u]
            dv = np.zeros((len(u), RANK))
            np.add.at(dv, uk, e[k, None] * (s[k] - vc))
            dv += decay * 10 * len(rows) * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += e.sum() ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= 0.3 * rate * dv / np.sqrt(gv[u])
            w0 -= rate * e.sum() / np.sqrt(g0)
    return Machine(ids[chosen], w0, w, v)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """A machine from at most ``train_docs`` labelled documents that aren't held out.

    Only the hashes of their terms come to the driver. A document labelled twice is toxic if any label says so.
    """
    toxic = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = toxic.count()
    if n > train_docs:
        share = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        toxic = toxic.where(share < train_docs / n)
    rows = docs.select("doc_id", "text").join(toxic, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [sorted(map(term, words(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bags, pa.list_(pa.int64()))], ["toxic", "terms"])

    got = rows.mapInArrow(run, "toxic int, terms array<long>").toArrow()
    order = np.argsort([hash(tuple(t[:8].tolist())) for t in (np.asarray(x.values) for x in got["terms"])], kind="stable")
    bags = [np.asarray(got["terms"][int(i)].values) for i in order]
    return fit(bags, np.asarray(got["toxic"])[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row; nulls and texts without letters score as empty ones."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            s = np.array([m.score(t.as_py()) for t in batch.column("text")], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double").add("predicted", "integer"))


def op5_machine(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
