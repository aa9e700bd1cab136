"""Language ID by segmentation-marginalised unigrams."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The public vocabulary: a rank file of byte pieces. Read on the driver only.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: At most so many documents of a language are learned from, the first by a hash, and of each so many characters.
TRAIN_DOCS, TRAIN_CHARS = 400, 20_000
#: Words of up to RUN bytes are worked on together, longer ones one by one; pieces are at most so long (the vocabulary's longest have 33).
RUN, PIECE = 32, 33
#: Probabilities are scaled by this for each byte, so that sums over RUN bytes of anything from 10^-13 to 1 a byte stay within a double.
SCALE = 1e4
#: Words whose scores a worker remembers.
CACHE = 400_000
UNKNOWN = "und"


_ALNUM = re.compile(r"[^\W\d_]+")


def letters(text: str) -> Counter:
    """The runs of letters (by Unicode category) of a text in lower case, and how often they occur."""
    out = Counter(_ALNUM.findall(text.lower()))
    for word in [w for w in out if not w.isalpha()]:  # numbers that are no decimal digits, as fractions
        n = out.pop(word)
        for run in "".join(c if c.isalpha() else " " for c in word).split():
            out[run] += n
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of up to PIECE bytes; all single bytes are among them, so every text can be cut into pieces."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in pieces if len(p) <= PIECE} | {bytes([b]) for b in range(256)})


def _unit(word: str) -> bytes:
    """What is scored: a word's UTF-8 with a space before it."""
    return (" " + word).encode("utf-8", "surrogatepass")


def units(text: str) -> Counter:
    """The units of each run of letters in lower case, and how often they occur."""
    return Counter({_unit(word): n for word, n in letters(text).items()})


class Lattice:
    """The pieces within each of some units: in arrays by length for those of up to RUN bytes, one by one for longer ones."""

    def __init__(self, found: list[bytes], index: dict[bytes, int]):
        self.size, self.groups, self.long = len(found), [], []
        by_length: dict[int, list[int]] = {}
        none = len(index)
        for k, u in enumerate(found):
            if len(u) <= RUN:
                by_length.setdefault(len(u), []).append(k)
            else:  # pieces that end at each place, the shortest first
                ids = [[index.get(u[j - k : j], none) if k <= j else none for k in range(1, PIECE + 1)] for j in range(1, len(u) + 1)]
                self.long.append((k, np.array(ids, dtype=np.int32)))
        for n, rows in by_length.items():
            spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - PIECE), j)]
            cuts = [slice(i, j) for i, j in spans]
            ids = np.array([list(map(index.get, map(found[k].__getitem__, cuts), repeat(none))) for k in rows], dtype=np.int32)
            self.groups.append((n, np.array(rows), spans, ids))

    def forward(self, scaled: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, for each unit and language.

        ``scaled`` has the pieces' probabilities times SCALE to the power of their length, and a zero row at the end.
        """
        out = np.empty((self.size, scaled.shape[1]))
        for n, rows, spans, ids in self.groups:
            out[rows] = np.log(self._alpha(n, spans, ids, scaled)[n]) - n * np.log(SCALE)
        for k, ids in self.long:
            out[k] = self._chain(ids, scaled)[1][-1] - len(ids) * np.log(SCALE)
        return out

    @staticmethod
    def _alpha(n: int, spans: list, ids: np.ndarray, scaled: np.ndarray) -> list[np.ndarray]:
        alpha = [np.ones((len(ids), scaled.shape[1]))] + [np.zeros((len(ids), scaled.shape[1])) for _ in range(n)]
        for s, (i, j) in enumerate(spans):
            alpha[j] += alpha[i] * scaled[ids[:, s]]
        return alpha

    @staticmethod
    def _chain(ids: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a long unit: the forward sums of the last PIECE places relative to the place before (for each place), and logs of all."""
        n, langs = len(ids), scaled.shape[1]
        logs = np.zeros((n + 1, langs))
        shares = np.zeros((n, PIECE, langs))
        for j in range(1, n + 1):
            k = min(j, PIECE)
            back = np.exp(logs[j - k : j][::-1] - logs[j - 1])
            shares[j - 1, :k] = back * scaled[ids[j - 1, :k]]
            total = shares[j - 1].sum(axis=0)
            shares[j - 1] /= total
            logs[j] = logs[j - 1] + np.log(total)
        return shares, logs

    def expected(self, scaled: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in each language, by forward and backward sums."""
        out = np.zeros_like(scaled)
        for n, rows, spans, ids in self.groups:
            alpha = self._alpha(n, spans, ids, scaled)
            beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [np.ones_like(alpha[0])]
            for s in range(len(spans) - 1, -1, -1):
                i, j = spans[s]
                beta[i] += beta[j] * scaled[ids[:, s]]
            scale = counts[rows] / alpha[n]
            for s, (i, j) in enumerate(spans):
                use = alpha[i] * beta[j] * scaled[ids[:, s]] * scale
                for lang in range(scaled.shape[1]):
                    out[:, lang] += np.bincount(ids[:, s], use[:, lang], len(out))
        for k, ids in self.long:
            # a piece that ends at a place is used as often as the place is reached, times its share there
            shares, _ = self._chain(ids, scaled)
            reached = np.zeros((len(ids) + 1, scaled.shape[1]))
            reached[-1] = counts[k]
            for j in range(len(ids), 0, -1):
                use = shares[j - 1] * reached[j]
                np.add.at(out, ids[j - 1], use)
                m = min(j, PIECE)
                reached[j - m : j] += use[:m][::-1]
        out[-1] = 0
        return out


def scaled(pieces: list[bytes], probs: np.ndarray) -> np.ndarray:
    """Probabilities (with a zero row last) as ``Lattice`` takes them."""
    return probs * np.r_[SCALE ** np.array([len(p) for p in pieces], dtype=float), 1.0][:, None]


def learn(samples: list[tuple[str, str]], pieces: list[bytes], rounds: int = 4, smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each piece in each (a zero row last), by expectation maximisation.

    ``samples`` are pairs of language and text. Each language's distribution is
    mixed with the common one (weight ``smooth``) and that with an even one.
    """
    langs = sorted({lang for lang, _ in samples})
    words: dict[bytes, np.ndarray] = {}
    for lang, text in samples:
        for u, n in units(text).items():
            words.setdefault(u, np.zeros(len(langs)))[langs.index(lang)] += n
    lattice = Lattice(list(words), {p: i for i, p in enumerate(pieces)})
    counts = np.array(list(words.values())).reshape(len(words), len(langs))
    length = np.array([len(p) for p in pieces])
    probs = np.zeros((len(pieces) + 1, len(langs)))
    probs[:-1] = (1.0 / (np.exp2(length) * np.bincount(length, minlength=PIECE + 1)[length]))[:, None]
    for _ in range(rounds):
        use = lattice.expected(scaled(pieces, probs), counts)[:-1]
        common = (use.sum(axis=1) + 0.01) / (use.sum() + 0.01 * len(pieces))
        own = use / np.maximum(use.sum(axis=0), 1)
        probs[:-1] = (1 - smooth) * own + smooth * common[:, None]
    return langs, probs


class Scorer:
    """Scores whole texts with a learned model; remembers the scores of words."""

    def __init__(self, langs: list[str], pieces: list[bytes], probs: np.ndarray):
        self.langs, self.scaled = langs, scaled(pieces, probs)
        self.index = {p: i for i, p in enumerate(pieces)}
        self.known: dict[bytes, int] = {}
        self.rows = np.empty((CACHE, len(langs)))

    def _learn(self, words: list[str]) -> None:
        """Rows for words not met before: the sums over all their segmentations."""
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            n = len(self.known)
            while n + len(some) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
            self.rows[n : n + len(some)] = Lattice(list(map(_unit, some)), self.index).forward(self.scaled)
            self.known.update(zip(some, range(n, n + len(some)), strict=True))

    def scores(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """The likeliest language and its posterior probability under even priors."""
        bags = [letters(t) if t else {} for t in texts]
        new = set().union(*bags).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = set().union(*bags)
        self._learn(list(new))
        for b in bags:
            if not b or not self.langs:
                yield UNKNOWN, 0.0
                continue
            at = np.fromiter(map(self.known.__getitem__, b), np.int64, len(b))
            total = np.fromiter(b.values(), np.float64, len(b)) @ self.rows[at]
            weight = np.exp(total - total.max())
            best = int(total.argmax())
            yield self.langs[best], float(weight[best] / weight.sum())


def train(docs: DataFrame, vocabulary_path: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> tuple[list[str], list[bytes], np.ndarray]:
    """A model from a bounded sample: of each language the ``train_docs`` documents that come first by a hash of the text, copies counted once.

    Of a longer text a passage of TRAIN_CHARS characters is learned from, from a place that its hash says. So no
    language is left out for the length of its texts, and at most train_docs * TRAIN_CHARS characters of each come to the driver.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", F.md5("text").alias("h"), "text", start.alias("start"))
    # a share by hash of each language, so that a common one is no hot group; its least hashes are then chosen
    # of the language's distinct texts, so that many copies of one don't empty its sample
    firsts = rows.select("lang", F.xxhash64("text").alias("t")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    if firsts.limit(10_001).count() <= 10_000:
        firsts = F.broadcast(firsts)
    share = rows.join(firsts, "lang").where(
        F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32) < F.lit(1.5 * train_docs) / F.col("n")
    )
    sample = share.select("lang", "h", F.substring("text", F.col("start"), F.lit(TRAIN_CHARS)).alias("text")).distinct().collect()
    chosen: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r.lang, r.h)):
        if len(chosen.setdefault(r.lang, [])) < train_docs:
            chosen[r.lang].append((r.lang, r.text))
    pieces = vocabulary(vocabulary_path)
    langs, probs = learn([x for some in chosen.values() for x in some], pieces)
    return langs, pieces, probs


def identify(docs: DataFrame, learned_from: DataFrame | None = None, vocabulary_path: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every row, after the columns in ``keep``.

    Learns from ``learned_from`` (``doc_id``, ``text``, ``lang``; ``docs`` itself by
    default). A null text or one without letters is ``und`` with score 0, and so is
    all if there is nothing to learn from. Texts are scored whole, and words of any length over all their segmentations. A worker remembers the scores of some words only.
    """
    langs, pieces, probs = train(learned_from if learned_from is not None else docs, vocabulary_path)
    # its size follows the vocabulary and the number of languages, not the documents
    model = docs.sparkSession.sparkContext.broadcast((langs, pieces, probs))
    keep = keep or ["doc_id"]
    text = "text" if "text" in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = list(scorer.scores(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    [*keep, "lang_pred", "score"],
                )

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return rows.mapInArrow(run, docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def accept(docs: DataFrame, sure: float = 0.5, **how) -> DataFrame:
    """``docs`` without the rows whose language is unknown or less than ``sure``; columns unchanged, whatever their names.

    Rows with null or blank texts or none but numbers and signs go; repeated rows are judged alike.
    """
    out = identify(docs.select(F.struct("*").alias("own"), "text"), docs, keep=["own"], **how)
    return out.where((F.col("lang_pred") != UNKNOWN) & ~F.isnan("score") & (F.col("score") >= sure)).select("own.*")


def op6_unigram(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
