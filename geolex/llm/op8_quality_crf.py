"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad by a two-state chain.  A
line's features are shares of its characters and words, whether the line
repeats, and the same of the lines before and after it; the chain's transition
weights carry what neighbouring labels say.  Forward-backward gives each line's
probability of being good, and their mean weighted by line length is the
document's quality, mapped to a probability by a logistic curve.

Training: labelled documents outside the held-out fold; all lines of a document
take its label.  The sample is bounded: at most ``SAMPLE_DOCS`` documents per
label (those whose ids have the smallest hashes, among documents of at most
``SAMPLE_LINES`` lines), weighted back to the labels' real proportion.  Scoring reads
every document whole.

Rules: null text counts as empty; an empty text is one empty line.  A document
with several label rows has their majority (ties: 1); null labels do not count.
Without labels of both kinds the score is the share of label 1 (1/2 without
any); so they have if no document of one kind is short enough.  Of a repeated id the smallest
text is learned from.  Rows are scored independently, and columns other than
``doc_id`` and ``text`` (``quality`` of the labels) are not read, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.llm.common import cut, held_out, in_arrow, named, table

SAMPLE_DOCS, SAMPLE_LINES = 1500, 400
STEPS, RATE, RIDGE = 200, 0.1, 1e-4
#: Characters whose features are computed at once in a task (more if one text has more).
CHUNK_CHARS = 1 << 20

LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL = range(6)
OWN = 15


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    def kind(c: str) -> int:
        major = unicodedata.category(c)
        if major[0] in "LM":
            return UPPER if major == "Lu" else LOWER
        return DIGIT if major[0] == "N" else SPACE if c.isspace() else STOP if c in ".,;:'\"()?-" else SYMBOL
    return np.array([kind(chr(c)) for c in range(0x110000)], np.uint8)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines with their neighbours', lengths of lines, lines per text)."""
    docs = [t.split("\n") for t in texts]
    counts = np.array([len(d) for d in docs])
    lines = [line for d in docs for line in d]
    size = np.array([len(line) for line in lines], np.float64)
    points = np.frombuffer("\n".join(lines + [""]).encode("utf-32-le"), "<u4")
    kind = kinds()[points]
    starts = (np.cumsum(size + 1) - size - 1).astype(np.int64)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64) / np.maximum(size, 1)

    twin = np.append(False, points[1:] == points[:-1])
    own = np.zeros((len(lines), OWN))
    own[:, 0] = np.log1p(size) / 8
    own[:, 1] = share(kind <= UPPER)
    own[:, 2] = share(kind == UPPER) / np.maximum(own[:, 1], 1e-3)
    own[:, 3] = share(kind == DIGIT)
    own[:, 4] = share((kind == SPACE) & (points != 10))
    own[:, 5] = share(kind == STOP)
    own[:, 6] = 3 * share(kind == SYMBOL)
    own[:, 7] = 3 * share(twin & (kind >= STOP))
    words = [line.split() for line in lines]
    many = np.array([len(w) for w in words], np.float64)
    distinct = np.array([len(set(w)) for w in words], np.float64)
    own[:, 8] = np.log1p(many) / 6
    own[:, 9] = size / np.maximum(many, 1) / 10
    own[:, 10] = 1 - distinct / np.maximum(many, 1)
    own[:, 11] = own[:, 10] * own[:, 8]
    seen = [Counter(d) for d in docs]
    own[:, 12] = [c[line] > 1 and line != "" for d, c in zip(docs, seen) for line in d]
    own[:, 13] = [line[-1:] in (".", "!", "?") for line in lines]
    own[:, 14] = 1
    np.clip(own, 0, 3, out=own)
    first, last = np.cumsum(counts) - counts, np.cumsum(counts) - 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first] = after[last] = 0
    return np.hstack([own, before, after]), size, counts


@dataclass
class Crf:
    weight: np.ndarray  # of the features, for good against bad
    moves: np.ndarray  # log weights [from, to]; 0 bad, 1 good
    start: np.ndarray
    slope: float
    shift: float

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probabilities (bad, good), and per document the expected moves.
        All documents advance together, line by line, longest first."""
        half = np.clip(features @ self.weight, -60, 60) / 2
        emit = np.exp(np.stack([-half, half], 1))
        moves, start = np.exp(self.moves), np.exp(self.start)
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        longest = int(counts.max(initial=0))
        live = np.searchsorted(-counts[order], -np.arange(longest), "left")  # documents with a line at step t
        forward, backward = np.empty_like(emit), np.ones_like(emit)
        expected = np.zeros((len(counts), 2, 2))
        now = None
        for t in range(longest):
            at = first[:live[t]] + t
            now = emit[at] * (start if t == 0 else now[:live[t]] @ moves)
            now /= now.sum(1, keepdims=True)
            forward[at] = now
        for t in range(longest - 2, -1, -1):
            at = first[:live[t + 1]] + t
            ahead = emit[at + 1] * backward[at + 1]
            pair = forward[at][:, :, None] * moves * ahead[:, None, :]
            expected[order[:live[t + 1]]] += pair / pair.sum((1, 2), keepdims=True)
            back = ahead @ moves.T
            backward[at] = back / back.sum(1, keepdims=True)
        both = forward * backward
        return both / both.sum(1, keepdims=True), expected

    def quality(self, features: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per document the mean probability of good, weighted by line length."""
        good = self.marginals(features, counts)[0][:, 1]
        first = np.cumsum(counts) - counts
        heavy = size + 1e-9  # an empty document is its one empty line
        return np.add.reduceat(good * heavy, first) / np.add.reduceat(heavy, first)

    def score(self, texts: list[str]) -> np.ndarray:
        odds = self.slope * self.quality(*line_features(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def adam(gradient, start: np.ndarray, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Gradient ascent with Adam's step sizes."""
    at, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(at)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        at = at + rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
    return at


def fit(features: np.ndarray, size: np.ndarray, counts: np.ndarray, label: np.ndarray, heavy: np.ndarray) -> Crf:
    """Maximises the labels' conditional likelihood per line, documents weighted by
    ``heavy``, and then fits the curve from quality to label."""
    width, per_line = features.shape[1], np.repeat(heavy / counts, counts)
    truth = np.repeat(label, counts)
    first = np.cumsum(counts) - counts
    total = heavy.sum()

    def model(v: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> Crf:
        return Crf(v[:width], v[width:width + 4].reshape(2, 2), v[width + 4:], slope, shift)

    def gradient(v: np.ndarray) -> np.ndarray:
        p, expected = model(v).marginals(features, counts)
        g = np.empty_like(v)
        g[:width] = features.T @ (per_line * (truth - p[:, 1]))
        moves = -(expected * (heavy / counts)[:, None, None]).sum(0)
        for y in (0, 1):
            moves[y, y] += ((counts - 1) * heavy / counts)[label == y].sum()
        g[width:width + 4] = moves.ravel()
        began = heavy / counts
        g[width + 4:] = [(began * ((label == y) - p[first, y])).sum() for y in (0, 1)]
        return g / total - RIDGE * v

    found = adam(gradient, np.zeros(width + 6))
    quality = model(found).quality(features, size, counts)

    def curve(v: np.ndarray) -> np.ndarray:
        miss = heavy * (label - 1 / (1 + np.exp(-np.clip(v[0] * quality + v[1], -60, 60))))
        return np.array([(miss * quality).sum(), miss.sum()]) / total - RIDGE * v

    slope, shift = adam(curve, np.array([4.0, -2.0]), 400)
    return model(found, slope, shift)


def learn(docs: DataFrame, labels: DataFrame) -> Crf | float:
    """The model, or the constant score where both labels are not there to learn from."""
    text = F.coalesce(named("text"), F.lit(""))
    given = docs.select(named("doc_id").alias("_id"), text.alias("_text")).filter(
        F.size(F.split("_text", "\n")) <= SAMPLE_LINES)
    known = (labels.select(named("doc_id").alias("_id"), named("quality").alias("_quality"))
             .filter(F.col("_quality").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id")
             .agg((F.avg("_quality") >= 0.5).cast("int").alias("label")))
    known = cut(known, "op8-labels")
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(totals) < 2:
        return float(sum(totals) if totals else 0.5)
    # only labels of documents short enough to learn from are drawn, so that both labels fill their sample
    short = known.join(given.select("_id"), "_id", "left_semi")
    parts = [short.filter(F.col("label") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS) for y in (0, 1)]
    chosen = cut(parts[0].union(parts[1]), "op8-sample")
    rows = (given.join(F.broadcast(chosen), "_id")  # 2 x SAMPLE_DOCS rows
            .groupBy("_id", "label").agg(F.min("_text").cast("binary").alias("text")))  # one text of a repeated id

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size, counts = line_features([t.as_py().decode("utf-8", "replace") for t in batch.column(2)])
            cuts = np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([a[:, :OWN].astype(np.float32).tobytes() for a in np.split(x, cuts)], pa.binary()),
                 pa.array([a.astype(np.float32).tobytes() for a in np.split(size, cuts)], pa.binary())],
                names=["_id", "label", "own", "size"])

    sample = in_arrow(rows, featured, "_id long, label int, own binary, size binary")
    rows = sorted(sample.collect(), key=lambda r: (r._id, bytes(r.own)))  # bounded: see the constants
    if len({r.label for r in rows}) < 2:
        return totals[1] / sum(totals.values())
    own = [np.frombuffer(r.own, np.float32).reshape(-1, OWN).astype(np.float64) for r in rows]
    zero = np.zeros((1, OWN))
    x = np.vstack([np.hstack([a, np.vstack([zero, a[:-1]]), np.vstack([a[1:], zero])]) for a in own])
    size = np.concatenate([np.frombuffer(r.size, np.float32) for r in rows]).astype(np.float64)
    label = np.array([r.label for r in rows])
    heavy = np.array([totals[y] for y in (0, 1)])[label] / np.bincount(label, minlength=2)[label]
    return fit(x, size, np.array([len(a) for a in own]), label, heavy / heavy.mean())


def score_quality(docs: DataFrame, model: Crf | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    given = docs.select(named(doc_id).alias("doc_id"),
                        F.coalesce(named(text), F.lit("")).cast("binary").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def runs(texts: list[str]) -> Iterator[list[str]]:
        run, size = [], 0
        for t in texts:
            if run and size + len(t) > CHUNK_CHARS:
                yield run
                run, size = [], 0
            run.append(t)
            size += len(t)
        if run:
            yield run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shipped.value
        for batch in batches:
            texts = [t.as_py().decode("utf-8", "replace") for t in batch.column(1)]
            scores = ([np.full(len(texts), crf)] if isinstance(crf, float) else [crf.score(r) for r in runs(texts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([np.empty(0), *scores]), pa.float64())],
                names=["doc_id", "score"])

    scored = in_arrow(given, run, given.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
