"""Vector code compression: product codes of integer vectors, fitted by a few rounds of Spark passes.

Vectors are cut into PARTS equal consecutive parts, each with a codebook of at most ENTRIES integer entries. The books start
from the rows of least id; each round is one pass in which every task assigns its rows' parts to their nearest entries and
sums what falls to each entry, so that only sums leave a task; they are added up by Spark and the driver gets one row for each
entry's component. The last pass writes codes and errors.

Assignment is a partial-distance search. Each part first gets one complete distance, to the entry nearest in the
dimension in which the entries vary most. Then each entry's distance grows dimension by dimension, in descending variance of
the codebook; rows whose sum strictly exceeds their best complete distance drop out of the mask, so ties survive and the
lower index wins. All arithmetic is in integers.

Defined cases: rows whose vector is null or has null or non-finite components are dropped. With fewer than ENTRIES rows there
are as many entries. Vectors that are shorter than the longest, and a length that PARTS doesn't divide, are filled up with
zeros. Rows with a null id stay and come last among the first entries; rows of one id come in order of their vectors.
Repeated rows give a row each. Sums of labels are shared by all rows of a label, nulls together. Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch, hot_join
from .vectors import lists, whole_vectors

PARTS, ENTRIES, ROUNDS, FACTOR = 8, 16, 6, 4096
#: Components of a batch that are handled at once.
COMPONENTS = 1 << 20


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry, and the squared distance."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable").tolist()
    lead = order[0]
    code = np.abs(x[:, lead, None] - book[None, :, lead]).argmin(axis=1)
    best = np.square(x - book[code]).sum(axis=1)
    for e in range(len(book)):
        at = np.flatnonzero(code != e)
        total = np.zeros(len(at), np.int64)
        for d in order:
            total += np.square(x[at, d] - book[e, d])
            stays = total <= best[at]
            if not stays.all():
                at, total = at[stays], total[stays]
        wins = (total < best[at]) | (e < code[at])
        at = at[wins]
        best[at], code[at] = total[wins], e
    return code, best


def _parts(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows of the column a few at a time, as an array of (row, part, position within the part)."""
    values, lengths = lists(column)
    ends = np.cumsum(lengths)
    step = max(1, COMPONENTS // (PARTS * width))
    for i in range(0, len(lengths), step):
        n = lengths[i : i + step]
        out = np.zeros((len(n), PARTS * width), np.int64)
        out[np.arange(PARTS * width) < n[:, None]] = values[ends[i] - lengths[i] : ends[i + len(n) - 1]]
        yield i, i + len(n), out.reshape(len(n), PARTS, width)


def _sums(held):
    """Of each part and entry: how many parts fall to it, and their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        _, entries, width = books.shape
        counts, totals = np.zeros((PARTS, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, _, x in _parts(batch.column(0), width):
                for p in range(PARTS):
                    code, _ = nearest(x[:, p], books[p])
                    counts[p] += np.bincount(code, minlength=entries)
                    by = np.argsort(code, kind="stable")
                    used, begin = np.unique(code[by], return_index=True)
                    totals[p, used] += np.add.reduceat(x[by, p], begin, axis=0)
        part, entry = np.nonzero(counts)
        at = np.repeat(np.arange(len(part)), width)
        spot = np.tile(np.arange(width), len(part))
        columns = [part[at].astype(np.int32), entry[at].astype(np.int32), spot.astype(np.int32), totals[part[at], entry[at], spot], counts[part[at], entry[at]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "spot", "total", "n"])

    return run


def _codes(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            codes, errors = [], []
            for _, _, x in _parts(batch.column(2), books.shape[2]):
                found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
                codes += [bytes(row).hex() for row in np.stack([c for c, _ in found], axis=1).astype(np.uint8)]
                errors.append(sum(e for _, e in found))
            errors = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return run


def fit_codebooks(vectors: DataFrame, scratch: Scratch) -> np.ndarray | None:
    """Books as an array of (part, entry, position) from the rows (vec_id, v); None without rows."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow()
    if not len(first):
        return None
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-longest // PARTS))
    books = np.concatenate([x for _, _, x in _parts(first.column("v").combine_chunks(), width)]).transpose(1, 0, 2).copy()
    # the square of a distance holds the squares of differences, twice as large
    top, low = vectors.select(F.array_max("v").alias("x"), F.array_min("v").alias("y")).agg(F.max("x"), F.min("y")).first()
    if top is not None and width * (top - low) ** 2 >= 1 << 60:
        raise OverflowError("squared distances leave 60 bits")
    for _ in range(ROUNDS):
        sent = scratch.spark.sparkContext.broadcast(books)
        sums = vectors.select("v").mapInArrow(_sums(sent), "part int, entry int, spot int, total long, n long")
        new = sums.groupBy("part", "entry", "spot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        part, entry, spot, total, n = (new.column(c).to_numpy() for c in ("part", "entry", "spot", "total", "n"))
        books = books.copy()
        books[part, entry, spot] = total // n
        sent.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Per row of rows with a finite vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vector-codes")
    kinds = dict(rows.dtypes)
    taken = rows.select("vec_id", "label", whole_vectors(rows, vector, FACTOR).alias("v")).where("v is not null")
    taken = scratch.save(taken, "vectors")
    books = fit_codebooks(taken, scratch)
    if books is None:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    sent = spark.sparkContext.broadcast(books)
    coded = scratch.save(taken.mapInArrow(_codes(sent), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    # nulls together: a key that is never null
    key = F.struct(F.col("label").isNull().alias("no"), F.col("label"))
    keyed = coded.withColumn("_key", F.to_json(key))
    sums = scratch.save(keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_k")), "labels")
    scratch.drop("vectors")
    whole = hot_join(keyed, sums, ["_key"], "_k", coded.count())
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """The same rows from DuckDB, each round a few common tables; vectors of equal length, divisible by PARTS."""
    out = f"""
with k as materialized (
  select vec_id, label, [floor({FACTOR} * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
w as (select coalesce(max(len(v)), 0) // {PARTS} as w from k),
x as materialized (select vec_id, p, v[p * w + 1 : (p + 1) * w] as x from k, w, range({PARTS}) r(p)),
c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from x qualify e < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        out += f""",
d{r} as (select vec_id, x.p, e, x, list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)])::bigint as d from x join c{r} on x.p = c{r}.p),
a{r} as materialized (select vec_id, p, e, x, d from d{r} qualify row_number() over (partition by vec_id, p order by d, e) = 1)"""
        if r < ROUNDS:
            out += f""",
s{r} as (select p, e, i, sum(x[i])::bigint as s, count(*) as n from (select p, e, x, unnest(range(1, len(x) + 1)) as i from a{r}) group by all),
m{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as c from s{r} group by all),
c{r + 1} as materialized (select p, e, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (p, e))"""
    return out + f""",
b as (select sha256(string_agg(z::varchar, ',' order by p, e, i)) as h from (select p, e, unnest(c) as z, unnest(range(1, len(c) + 1)) as i from c{ROUNDS})),
f as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from f join k using (vec_id), b"""
