"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's own features and those of the lines before
and after it give its score; neighbouring lines influence each other through
transition weights. Forward-backward gives each line's marginal probability of
being good, and the mean of these, weighted by the lines' lengths, gives the
document's quality, calibrated on the training documents.

Training takes at most ``SAMPLE`` labelled documents of at most
``SAMPLE_BYTES`` bytes and ``SAMPLE_LINES`` lines each (those whose ids hash
lowest; documented bounds, which also bound what the driver gathers), gives each line its document's label, and maximises the penalised conditional
likelihood. Scoring covers every document whole.

Defined cases: null and empty texts are one empty line and get a score; without
training documents of both labels every score is 0.5 (predicted 1, so that a
filter keeps everything); equal texts get equal scores, whatever is scored beside them; labels that contradict
each other for one id, and null ids and labels, are not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines
from .base import slices, small_batches

SAMPLE = 4000
SAMPLE_BYTES = 64 << 10
SAMPLE_LINES = 1024
FOLDS = 5
THRESHOLD = 0.3
#: Lines of a training sequence; longer documents are several.
SEQUENCE = 64


def fold(key: Column) -> Column:
    """The fold of an id: fold 0 is held out. A null id is in fold 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Chain:
    """Two-state chain. ``step[i, j]``: weight of state i followed by j; emission: weight of state 1 over 0."""

    def __init__(self, size: int):
        self.mean, self.scale = np.zeros(size), np.ones(size)
        self.weight, self.bias = np.zeros(size), 0.0
        self.step = np.zeros((2, 2))
        self.slope, self.level = 1.0, 0.0
        self.fitted = False

    def emission(self, x: np.ndarray) -> np.ndarray:
        # sums by rows do not depend on what else is in the batch
        return ((x - self.mean) / self.scale * self.weight).sum(1) + self.bias

    def marginals(self, emission: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of state 1 at each place of each row, and of each pair of states summed over the row.

        Forward and backward messages are log-odds of state 1, so nothing overflows.
        """
        rows, length = emission.shape
        t = self.step
        pass_on = lambda a: np.logaddexp(t[0, 1], a + t[1, 1]) - np.logaddexp(t[0, 0], a + t[1, 0])
        pass_back = lambda b: np.logaddexp(t[1, 0], b + t[1, 1]) - np.logaddexp(t[0, 0], b + t[0, 1])
        ahead, back = np.zeros((rows, length)), np.zeros((rows, length))
        for i in range(1, length):
            ahead[:, i] = np.where(mask[:, i], pass_on(ahead[:, i - 1] + emission[:, i - 1]), 0)
        for i in range(length - 2, -1, -1):
            back[:, i] = np.where(mask[:, i + 1], pass_back(back[:, i + 1] + emission[:, i + 1]), 0)
        p = 1 / (1 + np.exp(-np.clip(ahead + emission + back, -500, 500)))
        pairs = np.zeros((rows, 2, 2))
        if length > 1:
            left, right = (ahead + emission)[:, :-1], (emission + back)[:, 1:]
            joint = np.stack([np.stack([np.full_like(left, t[0, 0]), t[0, 1] + right], -1), np.stack([t[1, 0] + left, t[1, 1] + left + right], -1)], -2)
            joint = np.exp(joint - joint.max((-1, -2), keepdims=True))
            joint /= joint.sum((-1, -2), keepdims=True)
            pairs = (joint * mask[:, 1:, None, None]).sum(1)
        return p, pairs

    def fit(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.1, penalty: float = 2e-3) -> None:
        """x: features of all lines; starts: where sequences begin, and the end; labels: of the sequences."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = (x - self.mean) / self.scale
        sizes = np.diff(starts)
        row = np.repeat(np.arange(len(sizes)), sizes)
        column = np.arange(len(x)) - np.repeat(starts[:-1], sizes)
        mask = np.zeros((len(sizes), int(sizes.max())), bool)
        mask[row, column] = True
        y = labels[row]
        observed = np.zeros((2, 2))
        for s in (0, 1):
            observed[s, s] = (sizes[labels == s] - 1).sum()
        value = np.zeros(z.shape[1] + 5)
        first, second = np.zeros_like(value), np.zeros_like(value)
        for i in range(1, rounds + 1):
            self.weight, self.bias, self.step = value[:-5], float(value[-5]), value[-4:].reshape(2, 2)
            grid = np.zeros(mask.shape)
            grid[row, column] = z @ self.weight + self.bias
            p, pairs = self.marginals(grid, mask)
            off = y - p[row, column]
            grad = np.concatenate([z.T @ off, [off.sum()], (observed - pairs.sum(0)).ravel()]) / len(z) - penalty * value
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            value = value + rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
        self.weight, self.bias, self.step = value[:-5], float(value[-5]), value[-4:].reshape(2, 2)
        self.fitted = True

    def qualities(self, x: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document, before calibration."""
        e, sizes = self.emission(x), np.diff(starts)
        out = np.empty(len(sizes))
        # documents of like numbers of lines are worked on together
        level = np.ceil(np.log2(sizes)).astype(int)
        for k in np.unique(level):
            docs = np.flatnonzero(level == k)
            n = sizes[docs]
            row, column = np.repeat(np.arange(len(docs)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(starts[docs], n) + column
            grid, w, mask = np.zeros((len(docs), int(n.max()))), np.zeros((len(docs), int(n.max()))), np.zeros((len(docs), int(n.max())), bool)
            grid[row, column], w[row, column], mask[row, column] = e[at], weights[at], True
            w = np.where(w.sum(1, keepdims=True) > 0, w, mask)
            out[docs] = (self.marginals(grid, mask)[0] * w).sum(1) / w.sum(1)
        return out

    def calibrate(self, quality: np.ndarray, labels: np.ndarray) -> None:
        """Slope and level of the log-odds, by Newton steps."""
        v = _odds(quality)
        z, b = np.stack([v, np.ones_like(v)], 1), np.array([0.5, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ b))
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
            b = b + np.clip(np.linalg.solve(h, z.T @ (labels - p) - 1e-2 * b), -1, 1)
        self.slope, self.level = max(float(b[0]), 1e-3), float(b[1])

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts or not self.fitted:
            return np.full(len(texts), 0.5)
        made = [lines.rows(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in made])])
        q = self.qualities(np.concatenate([x for x, _ in made]), np.concatenate([w for _, w in made]), starts)
        # paddings of a batch may change the last bits: equal texts get equal scores
        return np.round(1 / (1 + np.exp(-(self.slope * _odds(q) + self.level))), 9)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, sample_lines: int = SAMPLE_LINES) -> Chain:
    """Trains on rows outside fold 0. The label table is sampled first; documents are only scanned for these ids."""
    some = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)").where(fold(F.col("key")) != 0)
    picked = some.orderBy(F.xxhash64("key"), "key", "label").limit(sample)  # at most ``sample`` rows: the broadcast is bounded
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes).where(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) < sample_lines)
    rows = own.join(F.broadcast(picked), "key").groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    found = _features(rows).orderBy("key").collect()
    chain = Chain(3 * len(lines.NAMES))
    y = np.array([r.label for r in found], np.int64)
    if len(set(y.tolist())) < 2:
        return chain
    x = [np.frombuffer(r.x, np.float32).reshape(-1, 3 * len(lines.NAMES)) for r in found]
    w = [np.frombuffer(r.w, np.float64) for r in found]
    sizes = [len(a) for a in x]
    cuts = [min(SEQUENCE, n - i) for n in sizes for i in range(0, n, SEQUENCE)]
    whose = [k for k, n in enumerate(sizes) for _ in range(0, n, SEQUENCE)]
    flat = np.concatenate(x).astype(np.float64)
    chain.fit(flat, np.concatenate([[0], np.cumsum(cuts)]), y[whose])
    chain.calibrate(chain.qualities(flat, np.concatenate(w), np.concatenate([[0], np.cumsum(sizes)])), y)
    return chain


def _features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [lines.rows(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([x.astype(np.float32).tobytes() for x, _ in made]), pa.array([w.tobytes() for _, w in made])], names=["key", "label", "x", "w"])

    small_batches(rows.sparkSession)
    return rows.select("key", "label", "text").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, label int, x binary, w binary")


def score(df: DataFrame, chain: Chain, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the quality score of each text."""
    keep = [f for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            made = chain.scores([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(made, pa.float64())], names=[f.name for f in keep] + [out])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` double"]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The documents that are not rejected, with their own columns. ``training``: where the labelled texts are, if elsewhere."""
    inner = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("text"))
    return score(inner, fit(docs if training is None else training, labels), out="quality_score").where(F.col("quality_score") >= THRESHOLD).select("row.*")
