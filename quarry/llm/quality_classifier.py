"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades, and ordered thresholds cut its score:
P(grade > k) = sigmoid(w . x - theta_k) with theta_0 < theta_1 < ... (kept ordered by learning the logs of their gaps).
So a document gets its expected grade and the tail probability of each grade or more, and selection keeps those whose
tail probability of ``least`` or more reaches ``cutoff``.

Features, all hashed: words (once each), shapes of words (letters, capitals, digits as classes, runs collapsed, other
characters as they are) by share of the words, and how many words repeat the one before.

Ratings here: 0 poor, 1 good but toxic, 2 good and not toxic, from the labels; any number of grades works, and ratings outside
of them count as the nearest. Training takes
at most SAMPLE whole documents of each grade, of at most sampling.SAMPLE_BYTES bytes together; scoring covers every whole
text. ``cutoff`` comes from a part of the sample that is not trained on: the highest that keeps KEEP of its documents of ``least`` or more.

Defined cases: null and empty texts have no words, are scored by the thresholds alone and are never selected. With fewer
than two grades seen every document gets that grade (or 0) and is kept if it has words. Repeated rows get a row each;
documents with several ratings count by the least; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .sampling import labelled_sample
from .scratch import bounded_batches
from .text import SPACE, Texts, chunks, column_bytes

SAMPLE, GRADES, LEAST, KEEP = 2500, 3, 1, 0.99
BITS, EPOCHS, SEED = 18, 8, 5
_U = np.uint64

#: Classes of bytes for shapes: a small letter or beyond ASCII, A capital, 9 digit; white space stays.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = 0x61
_SHAPE[0x80:] = 0x61
_SHAPE[0x41:0x5B] = 0x41
_SHAPE[0x30:0x3A] = 0x39


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices and values of the texts end to end, and their offsets."""
    n, counts = len(texts), texts.counts
    owner = np.repeat(np.arange(n), counts)
    words = texts.word_hashes()
    shape = _SHAPE[texts.data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = (shape[1:] != shape[:-1]) | SPACE[shape[1:]]
    keep[texts.offsets[:-1][texts.offsets[:-1] < len(shape)]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    shapes = Texts(shape[keep], place[texts.offsets]).word_hashes(lower=False)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    size = 1 << (BITS - 1)
    w = (words >> _U(64 - BITS + 1)).astype(np.int64)
    s = size + (shapes >> _U(64 - BITS + 2)).astype(np.int64)
    stutter = 2 * size - 1
    key, seen = np.unique(np.concatenate((owner, owner, owner[same])) * (2 * size) + np.concatenate((w, s, np.full(int(same.sum()), stutter))), return_counts=True)
    text, index = key // (2 * size), key % (2 * size)
    total = np.maximum(counts[text], 1)
    value = np.where(index < size, 1 / np.sqrt(total), 3 * seen / total).astype(np.float32)
    return index, value, np.searchsorted(text, np.arange(n + 1))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, grades: int):
        self.w = np.zeros(1 << BITS, np.float32)
        self.base, self.gaps = 0.0, np.zeros(grades - 2)
        self.constant: int | None = None
        self.cutoff = 0.5

    @property
    def thresholds(self) -> np.ndarray:
        return self.base + np.concatenate(([0], np.cumsum(np.exp(self.gaps))))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None], -30, 30)))

    def slopes(self, score: float, y: int) -> np.ndarray:
        """Of the log likelihood of grade y by each threshold; by the score it is the negative of their sum."""
        above = 1 / (1 + np.exp(-np.clip(score - self.thresholds, -30, 30)))  # P(> k)
        full, k = np.concatenate(([1.0], above, [0.0])), np.arange(len(above))
        p = max(full[y] - full[y + 1], 1e-6)
        slope = above * (1 - above)
        return (np.where(k == y, slope, 0) - np.where(k == y - 1, slope, 0)) / p

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray) -> None:
        r = np.random.default_rng(SEED)
        grades = len(self.gaps) + 2
        seen = np.full(len(self.w), 1e-4, np.float32)
        over, n = 1e-4 + np.zeros(grades - 1), np.bincount(grade, minlength=grades)
        weight = len(grade) / (grades * np.maximum(n, 1))
        for _ in range(EPOCHS):
            for i in r.permutation(len(rows)):
                index, value = rows[i]
                score, y = float(self.w[index] @ value), grade[i]
                d = self.slopes(score, y) * weight[y]
                g = -float(d.sum())  # by the score
                change = (g * value).astype(np.float32)
                seen[index] += change**2
                self.w[index] += 0.3 * change / np.sqrt(seen[index])
                over += d**2
                step = 0.1 * d / np.sqrt(over)
                self.base += float(step.sum())
                if len(self.gaps):
                    self.gaps += np.clip(np.cumsum(step[::-1])[::-1][1:] * np.exp(self.gaps), -0.2, 0.2)

    def score(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum((self.w[index] * value).astype(float))))
        return total[bounds[1:]] - total[bounds[:-1]]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        out = []
        for i, j in chunks(offsets):
            texts = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            index, value, bounds = features(texts)
            out += [(index[a:b].astype(np.int32).tobytes(), value[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "grade", "index", "value"])


def train(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int = GRADES, least: int = LEAST) -> Ordinal:
    kind = dict(docs.dtypes)["doc_id"]
    inside = F.when(grade.isNotNull(), F.least(F.greatest(grade.cast("int"), F.lit(0)), F.lit(grades - 1)))
    sample = labelled_sample(docs, ratings, inside, SAMPLE, ["doc_id", "text"])
    rows = sample.mapInArrow(_sampled, f"doc_id {kind}, grade int, index binary, value binary").orderBy(F.xxhash64("doc_id"), "index").collect()
    y = np.array([r.grade for r in rows], dtype=int)
    model = Ordinal(grades)
    if len(set(y.tolist())) < 2:
        model.constant = int(y[0]) if len(y) else 0
        return model
    pairs = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in rows]
    kept = np.arange(len(rows)) % 4 == 0
    if len(rows) < 40:
        kept[:] = False
    model.train([p for p, k in zip(pairs, kept) if not k], y[~kept])
    use = [i for i in range(len(rows)) if (kept[i] or not kept.any()) and y[i] >= least]
    if use:
        tails = model.tails(np.array([float(model.w[pairs[i][0]] @ pairs[i][1]) for i in use]))[:, least - 1]
        model.cutoff = min(0.5, float(np.quantile(tails, 1 - KEEP)))
    return model


def _score(held, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ordinal = held.value
        for batch in batches:
            n = batch.num_rows
            expected, tail, words = np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                texts = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                words[i:j] = texts.counts > 0
                if model.constant is None:
                    tails = model.tails(model.score(*features(texts)))
                    expected[i:j], tail[i:j] = tails.sum(1), tails[:, least - 1]
                else:
                    expected[i:j], tail[i:j] = model.constant, float(model.constant >= least)
            kept = words & ((tail >= model.cutoff) | (model.constant is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(kept)], ["doc_id", "expected_grade", "tail", "kept"])

    return run


def grade_documents(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int = GRADES, least: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, expected_grade, tail (the probability of grade ``least`` or more), kept."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, ratings, grade, grades, least))
    return docs.select("doc_id", "text").mapInArrow(_score(held, least), f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, tail double, kept boolean")


def label_grade() -> Column:
    """0 poor, 1 good but toxic, 2 good and not toxic; null without a quality."""
    return F.when(F.col("quality") > 0, F.when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)).when(F.col("quality") <= 0, 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), label_grade())
