"""Benchmark decontamination by pigeonhole edit matching.

Tokens are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased, so punctuation, line
breaks and case don't matter. A benchmark item of m tokens may occur with up to ``m // ERROR_EVERY`` token edits. It is
split into that many pieces and one more: an occurrence leaves one piece untouched, so every occurrence shows as an
exact piece hit. Hits are found by window hashes over the whole text, and verified with Myers' bit-parallel distance over
the item's reach around the hit.

The items are the query set. They are read in blocks of at most BLOCK_BYTES of text (one larger item is a block), and
each block is sent to the tasks and run against all documents; a block's size doesn't grow with anything.

Defined cases: null or empty texts match nothing; null items and items without tokens are not searched, short ones are, word for
word. An item may occur in a document more than once: a row for each
occurrence that doesn't overlap the one before. Items of equal tokens are searched once and reported each; their ids may be of any type. Repeated documents give their
rows each. Empty tables give an empty result, or all documents where these are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import bounded_batches, sieve
from .text import Texts, chunks, column_bytes, window_hashes

ERROR_EVERY, BLOCK_BYTES = 10, 16 << 20
_U = np.uint64

GAPS = np.zeros(256, dtype=bool)
GAPS[:128] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    GAPS[_a:_b] = False


def pieces_of(m: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of m tokens."""
    n = m // ERROR_EVERY + 1
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _steps(masks: dict[int, int], m: int, tokens: list[int], anchored: bool) -> Iterator[int]:
    """Myers: the distance of the pattern to what ends at each token; anchored: to what begins at the first."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for t in tokens:
        eq = masks.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh & full
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ((ph << 1) | anchored) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        yield score


def _masks(tokens: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(tokens):
        out[t] = out.get(t, 0) | 1 << i
    return out


class Block:
    """Some benchmark items with their pieces."""

    def __init__(self, rows: list[tuple[int, str]]):
        column = pa.array([t for _, t in rows], pa.string())
        data, offsets = column_bytes(column)
        texts = Texts(data, offsets, GAPS)
        hashes = texts.word_hashes()
        self.items = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        equal: dict[bytes, list] = {}
        for k, (item, _) in enumerate(rows):
            tokens = hashes[texts.first[k] : texts.first[k + 1]]
            m = len(tokens)
            if not m:
                continue
            if (twins := equal.get(tokens.tobytes())) is not None:
                twins.append(item)
                continue
            equal[tokens.tobytes()] = twins = [item]
            for start, length in pieces_of(m):
                key = int(window_hashes(tokens, np.array([start]), length)[0])
                found.setdefault(length, []).append((key, len(self.items), start))
            line = tokens.tolist()
            self.items.append((twins, m, m // ERROR_EVERY, _masks(line), _masks(line[::-1])))
        #: by length of piece: sorted keys, what they belong to, and a bitmap of their high bits
        self.pieces = []
        for length, entries in sorted(found.items()):
            entries.sort()
            keys = np.array([e[0] for e in entries], dtype=_U)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(keys >> _U(44)).astype(np.int64)] = True
            self.pieces.append((length, keys, [e[1:] for e in entries], seen))

    def matches(self, texts: Texts) -> list[tuple]:
        """(text, item_id, first token, token past the last, distance) of each occurrence, by text."""
        hashes = texts.word_hashes()
        hits = []
        for length, keys, owners, seen in self.pieces:
            grams, bounds = texts.windows(hashes, length)
            at = np.flatnonzero(seen[(grams >> _U(44)).astype(np.int64)])
            if not len(at):
                continue
            lo = np.searchsorted(keys, grams[at], side="left")
            hi = np.searchsorted(keys, grams[at], side="right")
            of = np.searchsorted(bounds, at, side="right") - 1
            for a, b, e, t in zip(lo.tolist(), hi.tolist(), at.tolist(), of.tolist()):
                for k in range(a, b):
                    item, start = owners[k]
                    hits.append((t, item, e - int(bounds[t]) - start, start))
        out = []
        last = None
        for t, item, begin, start in sorted(set(hits)):
            twins, m, budget, forward, backward = self.items[item]
            if last and last[:2] == (t, item) and begin + start < last[2]:
                continue  # inside the occurrence before
            first, count = int(texts.first[t]), int(texts.counts[t])
            lo, hi = max(begin - budget, 0, last[2] if last and last[:2] == (t, item) else 0), min(begin + m + budget, count)
            tokens = hashes[first + lo : first + hi].tolist()
            best, end = budget + 1, 0
            for j, score in enumerate(_steps(forward, m, tokens, False)):
                if score < best:
                    best, end = score, j + 1
            if best > budget:
                continue
            size, least = 0, m + 1
            for j, score in enumerate(_steps(backward, m, tokens[:end][::-1], True)):
                if score < least:
                    least, size = score, j + 1
            out += [(t, ident, lo + end - size, lo + end, best) for ident in twins]
            last = (t, item, lo + end)
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of bounded size, by the hash of their texts."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-2 * total // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


_OUT = "first_token int, end_token int, distance int"


def _search(held, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(held.value)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found = []
            for i, j in chunks(offsets):
                part = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], GAPS)
                found += [(i + x[0], *x[1:]) for x in block.matches(part)]
            cols = [batch.column(0).take(pa.array([x[0] for x in found], pa.int32()))]
            cols += [pa.array([x[k] for x in found], of) for k, of in ((1, kind), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "first_token", "end_token", "distance"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each occurrence of an item in a document: doc_id, item_id, first_token, end_token, distance."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, {_OUT}"
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for rows in blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(_search(spark.sparkContext.broadcast(rows), kind), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _sieve(held, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(held.value)
        for batch in batches:
            data, offsets = column_bytes(batch.column(text_at))
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, j in chunks(offsets):
                part = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], GAPS)
                keep[[i + x[0] for x in block.matches(part)]] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item occurs, unchanged and without a shuffle."""
    bounded_batches(docs.sparkSession)
    for rows in blocks(benchmark):
        docs = sieve(docs, _sieve(docs.sparkSession.sparkContext.broadcast(rows), docs.columns.index("text")))
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
