"""Hard negatives by a full score sort for each anchor.

Anchors are the query set and are read in blocks of bounded bytes; each block is sent to the tasks and run against all rows,
twice. A task takes its rows a batch at a time, computes the integer scores of all anchors of the block, and sorts each
anchor's scores with the ids (rows of a batch are put in order of id first, so a stable sort by score is the lexsort of
both). From the sorted rows the first run reads the positives, those of the anchor's label. The second, which knows the
positives' scores, finds each positive's upper limit in the different-label rows by binary search and reads on from there down
to the lower limit. A task holds the best few of each anchor and positive over its batches; those of all tasks are merged by
a window over anchors. Every row is scored with every anchor, so nothing is missed; no pair of rows is written.

Scores are exact: products of the norms bound every partial sum, so matrices are multiplied in 32-bit floats below 2**24, in
64-bit floats below 2**53 and in integers beyond; scores of 2**56 or more are refused.

Defined cases: rows with a null label or id, a null vector, or null or non-finite components take no part. Vectors of
different lengths have no score and don't meet. Repeated rows are rows each, so a copy of an anchor can be its positive,
and a repeated anchor gives its rows again. Labels are integers of any range. A label without a second row gives no
positives; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch
from .vectors import matrices, whole_vectors

POSITIVES, NEGATIVES, LOW_PERCENT, FACTOR = 5, 5, 80, 256
#: Bytes of anchors and of what a task holds for them; scores computed at once.
BLOCK_BYTES, SCORES = 64 << 20, 1 << 21

_FOUND = "anchor long, nth int, score long, id long, row long"
#: Less than any score; its negative is a number too.
_NONE = -(1 << 62)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer matrices as int64."""
    norm = lambda m: float(np.sqrt(np.square(m.astype(np.float64)).sum(axis=1).max(initial=0.0)))
    bound = norm(anchors) * norm(rows) * 1.001
    if bound >= 2**56:
        raise OverflowError("inner products of 2**56 or more")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)


class _Best:
    """The first ``size`` (score, id, row) of each of n lists, by score descending, id and row."""

    def __init__(self, n: int, size: int):
        self.score = np.full((n, size), _NONE)
        self.id = np.zeros((n, size), np.int64)
        self.row = np.zeros((n, size), np.int64)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        size = self.score.shape[1]
        if not len(score) or score[0] < self.score[i, -1]:
            return
        s, d, r = (np.concatenate((x[i], y[:size])) for x, y in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((r, d, -s))[:size]
        self.score[i], self.id[i], self.row[i] = s[order], d[order], r[order]

    def batches(self, keys: np.ndarray, per: int) -> Iterator[pa.RecordBatch]:
        """Rows for what was found; list i is the (i % per)-th of keys[i // per]."""
        for a in range(0, len(self.score), 1 << 14):
            part = self.score[a : a + (1 << 14)]
            at, spot = np.nonzero(part != _NONE)
            at += a
            columns = [keys[at // per], (at % per).astype(np.int32), self.score[at, spot], self.id[at, spot], self.row[at, spot]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "nth", "score", "id", "row"])


def _sorted_scores(held, batches: Iterator[pa.RecordBatch]):
    """For each batch and anchor: the anchor's number, and score, label, id and row of the batch, best first."""
    for batch in batches:
        ids, rows, labels = (batch.column(k).to_numpy() for k in range(3))
        for at, matrix in matrices(batch.column(3)):
            order = np.lexsort((rows[at], ids[at]))
            at, matrix = at[order], matrix[order]
            for numbers, anchors in held["matrices"]:
                if anchors.shape[1] != matrix.shape[1]:
                    continue
                step = max(1, SCORES // len(at))
                for k in range(0, len(numbers), step):
                    table = scores(anchors[k : k + step], matrix)
                    for number, score in zip(numbers[k : k + step].tolist(), table):
                        by = np.argsort(-score, kind="stable")
                        yield number, score[by], labels[at[by]], ids[at[by]], rows[at[by]]


def _positives(held, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best = _Best(len(block["row"]), size)
        for i, score, labels, ids, rows in _sorted_scores(block, batches):
            same = np.flatnonzero((labels == block["label"][i]) & (rows != block["row"][i]))[:size]
            best.add(i, score[same], ids[same], rows[same])
        yield from best.batches(block["row"], 1)

    return run


def _negatives(held, size: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        limits = block["limits"]
        per = limits.shape[1]
        best = _Best(len(limits) * per, size)
        for i, score, labels, ids, rows in _sorted_scores(block, batches):
            other = np.flatnonzero(labels != block["label"][i])
            score, ids, rows = score[other], ids[other], rows[other]
            for p, limit in enumerate(limits[i].tolist()):
                if limit == _NONE:
                    break
                begin = int(np.searchsorted(-score, -limit))
                end = begin + int((100 * score[begin : begin + size] >= low * limit).sum())
                best.add(i * per + p, score[begin:end], ids[begin:end], rows[begin:end])
        yield from best.batches(block["row"], per)

    return run


def _blocks(anchors: DataFrame) -> Iterator[DataFrame]:
    """The anchors in blocks of about BLOCK_BYTES at most, by the hash of their rows."""
    held = 24 * (POSITIVES * NEGATIVES + POSITIVES)
    total = anchors.agg(F.coalesce(F.sum(F.size("v") * 8 + held), F.lit(0))).first()[0]
    n = -(-2 * total // BLOCK_BYTES) if total > BLOCK_BYTES else min(total, 1)
    for k in range(n):
        yield anchors if n == 1 else anchors.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k)


def _first(found: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def mine_hard_negatives(rows: DataFrame, anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, factor: int = FACTOR, vector: str = "embedding") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among rows.

    Components are floor(factor * x). Positives are the anchor's best rows of its label, negatives of a positive the
    best rows of other labels whose score is at most the positive's and at least low_percent hundredths of it.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    v = whole_vectors(rows, vector, factor)
    taken = rows.select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    taken = scratch.save(taken.where("id is not null and label is not null and v is not null"), "rows")
    anchors = scratch.save(taken.where("anchor").select("row", "id", "label", "v"), "anchors")
    taken = taken.select("id", "row", "label", "v")
    near, far = [], []
    for k, block in enumerate(_blocks(anchors)):
        table = block.toArrow()
        held = {"row": table.column("row").to_numpy(), "label": table.column("label").to_numpy(), "matrices": matrices(table.column("v"))}
        sent = spark.sparkContext.broadcast(held)
        near.append(scratch.save(_first(taken.mapInArrow(_positives(sent, positives), _FOUND), positives), f"positives-{k}"))
        limits = np.full((len(table), positives), _NONE)
        found = near[-1].select("anchor", "place", "score").toArrow()
        order = np.argsort(held["row"])
        number = order[np.searchsorted(held["row"], found.column("anchor").to_numpy(), sorter=order)]
        limits[number, found.column("place").to_numpy() - 1] = found.column("score").to_numpy()
        sent.unpersist()
        sent = spark.sparkContext.broadcast(held | {"limits": limits})
        far.append(scratch.save(_first(taken.mapInArrow(_negatives(sent, negatives, low_percent), _FOUND), negatives), f"negatives-{k}"))
        sent.unpersist()
    if not near:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    one, other = near[0], far[0]
    for p, n in zip(near[1:], far[1:]):
        one, other = one.unionByName(p), other.unionByName(n)
    scratch.drop("rows")
    one = one.select("anchor", (F.col("place") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    other = other.select("anchor", "nth", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return other.join(one, ["anchor", "nth"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


ORACLE = f"""
with p as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor({FACTOR} * x::double)::bigint for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_sum([a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)])::bigint as score
  from p a join p b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
pos as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from pos join s using (anchor_id)
where label <> own and {LOW_PERCENT} * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= {NEGATIVES}"""
