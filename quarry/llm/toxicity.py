"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a run of letters, digits and characters beyond ASCII, A-Z lower-cased) has the sum of two rows of one embedding
table, chosen by two hashes. Filters of the widths WIDTHS slide over the whole text, a rectifier and the maximum over
all positions follow, and a logistic layer gives the score. Labels, language, source and id are no inputs.

Training takes at most SAMPLE labelled documents of each class, of at most sampling.SAMPLE_BYTES bytes together, whole;
the sample is all that reaches the driver. Part of it is kept to calibrate: the score's zero is put where the expected F1 under the labels' own
shares is best, so that 0.5 is the general threshold; then each language with enough calibration documents gets its own
threshold, which only ``flagged`` uses. Every document is scored over its whole text.

Defined cases: null and empty texts are scored as a text of one padding word. Texts shorter than a filter are padded.
Without labels of both classes every score is the share of toxic labels seen, 0 if there are none. Repeated rows get a
row each; null ids are not held out and not trained on; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontaminate import GAPS
from .sampling import fold, labelled_sample
from .scratch import bounded_batches
from .text import Texts, chunks, column_bytes

SAMPLE = 2500
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 12, (1, 2, 3)
EPOCHS, BATCH, SEED = 6, 32, 7
#: Calibration documents of each class that a language needs for a threshold of its own.
LEAST_LANGUAGE = 20
_U = np.uint64


def word_rows(texts: Texts) -> np.ndarray:
    """Two rows of the table for each word."""
    h = texts.word_hashes()
    return np.stack([(h >> _U(46)).astype(np.int32), ((h >> _U(20)) & _U(BUCKETS - 1)).astype(np.int32)], axis=1)


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = np.float32
        self.table = r.normal(0, 0.1, (BUCKETS, DIM)).astype(f)
        self.filters = [r.normal(0, 0.4 / np.sqrt(w), (w * DIM, FILTERS)).astype(f) for w in WIDTHS]
        self.bias = [np.full(FILTERS, 0.05, f) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(f)
        self.shift = 0.0

    def embed(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of texts end to end, each text followed by padding, and the texts' offsets."""
        pad = max(WIDTHS) - 1
        full = counts + pad + (counts == 0)
        bounds = np.concatenate(([0], np.cumsum(full)))
        x = np.zeros((bounds[-1], DIM), np.float32)
        at = np.arange(len(rows)) + np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
        x[at] = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        return x, bounds

    def pooled(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The maximum over each text of every filter."""
        n = len(x)
        parts = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            y = x @ f[:DIM]
            for k in range(1, w):
                y[: n - k] += x[k:] @ f[k * DIM : (k + 1) * DIM]
            # windows must not reach into the next text: its padding is as long as the widest filter less one
            drop = max(WIDTHS) - 1
            stops = bounds[1:] - drop
            cuts = np.empty(2 * len(stops), dtype=np.int64)
            cuts[0::2], cuts[1::2] = bounds[:-1], stops
            parts.append(np.maximum.reduceat(y, cuts, axis=0)[0::2] + b)
        return np.maximum(np.concatenate(parts, axis=1), 0)

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.empty(0)
        x, bounds = self.embed(rows, counts)
        return (self.pooled(x, bounds) @ self.out).astype(float) - self.shift

    def backward(self, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, bias: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the mean log loss: by the logits, by filters, their biases and the output (with decay), and places of x with theirs."""
        maxima, where = [], []
        for w, filt, b in zip(WIDTHS, self.filters, self.bias):
            y = x @ filt[:DIM]
            for k in range(1, w):
                y[: len(x) - k] += x[k:] @ filt[k * DIM : (k + 1) * DIM]
            at = np.stack([bounds[i] + y[bounds[i] : bounds[i + 1] - max(WIDTHS) + 1].argmax(0) for i in range(len(bounds) - 1)])
            where.append(at)
            maxima.append(np.take_along_axis(y, at, axis=0) + b)
        h = np.concatenate(maxima, axis=1)
        on = h > 0
        h = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-(h @ self.out + bias)))
        g = ((p - labels) / len(labels)).astype(np.float32)
        back = np.outer(g, self.out) * on
        grads: list[np.ndarray] = []
        dx: dict = {"at": [], "d": []}
        for j, (w, filt) in enumerate(zip(WIDTHS, self.filters)):
            d, at = back[:, j * FILTERS : (j + 1) * FILTERS], where[j]
            gf = np.zeros_like(filt)
            for k in range(w):
                part = x[at + k]  # texts, filters, DIM
                gf[k * DIM : (k + 1) * DIM] = np.einsum("tfd,tf->df", part, d)
                dx["at"].append((at + k).ravel())
                dx["d"].append((d[:, :, None] * filt[k * DIM : (k + 1) * DIM].T[None]).reshape(-1, DIM))
            grads.append(gf + 1e-4 * filt)
        grads += [back[:, j * FILTERS : (j + 1) * FILTERS].sum(0) for j in range(len(WIDTHS))]
        grads.append(h.T @ g + 1e-4 * self.out)
        return g, grads, np.concatenate(dx["at"]), np.concatenate(dx["d"])

    def train(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        r = np.random.default_rng(SEED)
        f = np.float32
        params = [*self.filters, *self.bias, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        seen = np.zeros(BUCKETS, f)
        bias, step = 0.0, 0
        for _ in range(epochs):
            for batch in np.array_split(r.permutation(len(docs)), max(1, len(docs) // BATCH)):
                rows = np.concatenate([docs[i] for i in batch])
                counts = np.array([len(docs[i]) for i in batch])
                x, bounds = self.embed(rows, counts)
                g, grads, places, slopes = self.backward(x, bounds, labels[batch], bias)
                bias -= 0.5 * float(g.sum())
                # from places in x to words, from words to rows of the table
                word = np.full(len(x), -1, dtype=np.int64)
                word[np.arange(len(rows)) + np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts)] = np.arange(len(rows))
                at = word[places]
                at, d = at[at >= 0], slopes[at >= 0]
                for side in (0, 1):
                    idx, inv = np.unique(rows[at, side], return_inverse=True)
                    total = np.zeros((len(idx), DIM), f)
                    np.add.at(total, inv, d)
                    seen[idx] += (total**2).mean(1)
                    self.table[idx] -= 0.15 * total / (np.sqrt(seen[idx])[:, None] + 1e-6)
                step += 1
                for q, gq, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (gq - m)
                    v += 0.001 * (gq**2 - v)
                    q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.shift = -bias


def best_threshold(logits: np.ndarray, labels: np.ndarray, share: float) -> float:
    """Where the expected F1 is best if a share of all documents has label 1."""
    weight = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum(np.where(labels[order] == 1, weight[order], 0))
    f1 = 2 * hit / (np.cumsum(weight[order]) + share)
    k = int(np.argmax(f1))
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2)


class Model:
    """A trained network, its language thresholds, or a constant where there was nothing to learn."""

    def __init__(self, network: Network | None, constant: float = 0.0, thresholds: dict[str, float] | None = None):
        self.network, self.constant, self.thresholds = network, constant, thresholds or {}

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.constant)
        if self.network is not None:
            data, offsets = column_bytes(column)
            for i, j in chunks(offsets):
                texts = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], GAPS)
                out[i:j] = 1 / (1 + np.exp(-np.clip(self.network.logits(word_rows(texts), texts.counts), -30, 30)))
        return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        blobs: list[bytes] = []
        for i, j in chunks(offsets):
            texts = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], GAPS)
            rows = word_rows(texts)
            blobs += [rows[a:b].tobytes() for a, b in zip(texts.first[:-1], texts.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(blobs, pa.binary())], ["doc_id", "lang", "label", "words"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows of labels (doc_id, toxic) outside of the held-out fold."""
    usable = labels.where(fold() != 0)
    share = usable.where("toxic is not null").agg(F.coalesce(F.avg((F.col("toxic") > 0).cast("double")), F.lit(0.0))).first()[0]
    sample = labelled_sample(docs, usable, (F.col("toxic") > 0).cast("int"), SAMPLE, ["doc_id", "text", F.col("lang").cast("string").alias("lang")])
    kind = dict(docs.dtypes)["doc_id"]
    rows = sample.mapInArrow(_words, f"doc_id {kind}, lang string, label int, words binary").orderBy(F.xxhash64("doc_id"), "words").collect()
    y = np.array([r.label for r in rows], dtype=int)
    if len(set(y.tolist())) < 2:
        return Model(None, share)
    words = [np.frombuffer(r.words, dtype=np.int32).reshape(-1, 2) for r in rows]
    kept = np.arange(len(rows)) % 4 == 0  # to calibrate
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(rows), dtype=bool)
    network = Network()
    network.train([w for w, k in zip(words, kept) if not k], y[~kept])
    use = np.flatnonzero(kept) if kept.any() else np.arange(len(rows))
    logits = np.concatenate([network.logits(words[i], np.array([len(words[i])])) for i in use])
    shift = best_threshold(logits, y[use], share)
    network.shift += shift
    logits -= shift
    thresholds = {}
    langs = np.array([rows[i].lang or "" for i in use], dtype=object)
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        if min((y[use][own] == 1).sum(), (y[use][own] == 0).sum()) >= LEAST_LANGUAGE:
            thresholds[lang] = float(1 / (1 + np.exp(-best_threshold(logits[own], y[use][own], share))))
    return Model(network, thresholds=thresholds)


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            score = model.scores(batch.column(1))
            limit = np.array([model.thresholds.get(x or "", 0.5) for x in batch.column(3).to_pylist()])
            columns = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(limit), pa.array(score >= limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "lang_threshold", "flagged"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, lang_threshold, flagged."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(_score(held), f"doc_id {kind}, held_out boolean, score double, predicted int, lang_threshold double, flagged boolean")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
