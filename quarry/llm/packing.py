"""Best-fit packing of token sequences by length patterns.

Every text is tokenised whole and ended with ``end_id``. Documents longer than ``capacity`` are cut into pieces of
``capacity`` tokens, the first of which takes the remainder; nothing else is cut. What is packed then is only a
histogram of piece lengths, ``capacity`` counts whatever the size of the corpus:

1. Patterns of a few lengths that fill a sequence (nearly) exactly are enumerated: for each length the lengths that
   complete it to one, two, three or four pieces.
2. Non-negative least squares (multiplicative updates) fits how often each pattern is repeated to the histogram.
3. The counts are rounded down to what the histogram still holds, and best-fit decreasing packs the residual lengths,
   again on counts: many pieces of one length enter sequences of one room at once.

The plan is a table of runs (length, first rank, last rank, sequence of the first, offset); its size is bounded by the
number of patterns. Pieces get their rank inside their length by hash buckets with a prefix sum of bucket counts, so a
length that a third of all pieces has is never gathered in one task, and take their place from the plan by a join.

Tokens: words repeat, so each batch is cut into the tokenizer's own pre-tokens by array operations, and only distinct
pre-tokens are encoded. Texts with characters or contractions that the fast cutter doesn't cover are encoded whole.

Defined cases: a null or empty text is one piece of just the end token. Repeated rows are documents of their own. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch, partitions
from .text import _powers, chunks, column_bytes, mix

_U = np.uint64
CAPACITY, END_ID = 2048, 0
#: Distinct pre-tokens whose ids a worker keeps.
CACHE = 1 << 20
#: Patterns leave no more than this many places free.


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# classes of characters: 0 the library decides, 1 letter, 2 number, 3 white space, 4 other
_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Classes of the code points below U+0250 and of common punctuation; the rest is left to the library."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        table = np.zeros(0x110000, dtype=np.uint8)
        for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
            x = chr(c)
            table[c] = 1 if regex.match(r"\p{L}", x) else 2 if regex.match(r"\p{N}", x) else 3 if regex.match(r"\s", x) else 4
        table[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = 0  # white space to some engines only
        _CLASSES = table
    return _CLASSES


class Encoder:
    """Token ids of whole texts, by the library's tokenizer, with one encoding for each distinct pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.keys = np.empty(0, dtype=_U)
        self.begins = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        ids = [x.ids for x in found]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum()))
        if len(self.keys) + len(keys) > CACHE:
            self.keys, self.begins, self.sizes, self.ids = self.keys[:0], self.begins[:0], self.sizes[:0], self.ids[:0]
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        order = np.argsort(np.concatenate((self.keys, keys)), kind="stable")
        self.keys = np.concatenate((self.keys, keys))[order]
        self.begins = np.concatenate((self.begins, begins))[order]
        self.sizes = np.concatenate((self.sizes, sizes))[order]
        self.ids = np.concatenate((self.ids, flat))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        texts = data.tobytes().decode("utf-8")
        points = np.frombuffer(texts.encode("utf-32-le"), dtype=np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        bounds = lead[offsets]
        n, kind = len(points), _classes()[points]
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(size)), size)
        # texts for the library
        odd = kind == 0
        if n > 1:
            odd[:-1] |= (points[:-1] == 0x27) & np.isin(points[1:], np.frombuffer("strvlmdST RVLMD".encode("utf-32-le"), dtype=np.uint32))
        hard = np.bincount(owner[odd], minlength=len(size)) > 0
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True
        first = first[:n]
        last = np.zeros(n + 1, dtype=bool)
        last[bounds] = True
        last = last[1 : n + 1]
        before = np.concatenate(([0], kind[:-1]))
        after = np.concatenate((kind[1:], [0]))
        space = kind == 3
        blank = np.concatenate(([False], points[:-1] == 0x20)) & ~first
        start = np.where(space, first | (before != 3) | (~last & (after != 3)), first | ((kind != before) & ~blank))
        at = np.flatnonzero(start & ~hard[owner])
        # a token ends where the next starts, or with its text
        stop = np.append(at[1:], n)
        stop = np.minimum(stop, bounds[1:][owner[at]])
        up, down = _powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, dtype=_U)
            total[0] = 0
            np.cumsum((points.astype(_U) + _U(1)) * up[:n], out=total[1:])
            keys = mix((total[stop] - total[at]) * down[at] + mix(stop - at))
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        _, known = self._find(distinct)
        new = np.flatnonzero(~known)
        if len(self.keys) + len(new) > CACHE:
            new = np.arange(len(distinct))  # the cache starts again with what this batch needs
        if len(new):
            self._learn(distinct[new], [texts[a:b] for a, b in zip(at[where[new]].tolist(), stop[where[new]].tolist())])
        spot, _ = self._find(distinct)
        spot = spot[which]
        sizes = self.sizes[spot]
        ends = np.cumsum(sizes)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - self.begins[spot], sizes)]
        cuts = np.concatenate(([0], ends))[np.searchsorted(at, bounds)]
        return [self.whole(texts[bounds[i] : bounds[i + 1]]) if hard[i] else flat[cuts[i] : cuts[i + 1]] for i in range(len(size))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first takes the remainder."""
    head = n % capacity or capacity
    return [(0, head)] + [(k, capacity) for k in range(head, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            rows: list[int] = []
            piece, start, length, crc = [], [], [], []
            for i, j in chunks(offsets):
                for k, ids in enumerate(coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for m, (a, n) in enumerate(cut(len(ids), capacity)):
                        rows.append(i + k)
                        piece.append(m)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(ids[a : a + n]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Multisets of one to four lengths, each with pieces, that fill a sequence exactly; counts: of each length from 0 on.

    For each length as the largest: the one that completes it, and balanced and unbalanced choices for two and three more.
    """
    have = np.flatnonzero(counts)
    held = set(have.tolist())
    found: set[tuple[int, ...]] = set()
    for a in have.tolist():
        rest = capacity - a
        if rest in held:
            found.add(tuple(sorted((a, rest), reverse=True)))
        # the most frequent partners of a that leave room for another piece
        near = have[have < rest]
        near = near[np.argsort(-counts[near], kind="stable")[:24]].tolist()
        for b in near:
            if rest - b in held:
                found.add(tuple(sorted((a, b, rest - b), reverse=True)))
            for c in near[:12]:
                d = rest - b - c
                if d > 0 and d in held:
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    if capacity in held:
        found.add((capacity,))
    return sorted(found, reverse=True)


def fit(counts: np.ndarray, choice: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative repeats of each pattern that fit the histogram in weighted least squares, by multiplicative updates."""
    if not choice:
        return np.empty(0)
    rows = np.concatenate([np.array(p) for p in choice])
    cols = np.repeat(np.arange(len(choice)), [len(p) for p in choice])
    target = counts.astype(float)
    weight = 1 / np.maximum(target, 1)
    x = np.full(len(choice), target.sum() / max(len(rows), 1))
    aim = np.bincount(cols, weights=(weight * target)[rows], minlength=len(choice))
    for _ in range(rounds):
        now = np.bincount(rows, weights=x[cols], minlength=len(counts))
        x *= aim / np.maximum(np.bincount(cols, weights=(weight * now)[rows], minlength=len(choice)), 1e-300)
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset), one piece in each of ``count`` sequences, and the number of sequences."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(lengths: tuple[int, ...], times: int, first: int, offset: int) -> None:
        for n in lengths:
            runs.append((n, int(used[n]), times, first, offset))
            used[n] += times
            left[n] -= times
            offset += n

    choice = patterns(left, capacity)
    repeats = fit(left, choice)
    for final in (False, True):  # rounded counts first; then what exact patterns can still take
        for k in np.argsort(-repeats, kind="stable"):
            need: dict[int, int] = defaultdict(int)
            for n in choice[k]:
                need[n] += 1
            most = min(int(left[n]) // m for n, m in need.items())
            times = most if final else min(most, int(repeats[k]))
            if times:
                place(choice[k], times, sequences, 0)
                sequences += times
    # best fit of the rest, longest first, on counts: bins of one room are handled together
    rooms: dict[int, list[list[int]]] = defaultdict(list)  # room -> [first sequence, how many]
    for n in range(capacity, 0, -1):
        room = n
        while left[n]:
            while room < capacity and not rooms.get(room):
                room += 1
            if room >= capacity:
                # each new sequence takes as many of these as it holds, or as are left
                each = capacity // n
                full, more = divmod(int(left[n]), each)
                for times, k in ((full, each), (1, more)):
                    if times and k:
                        place((n,) * k, times, sequences, 0)
                        if k * n < capacity:
                            rooms[capacity - k * n].append([sequences, times])
                        sequences += times
                break
            group = rooms[room][-1]
            times = min(group[1], int(left[n]))
            first = group[0] + group[1] - times
            place((n,), times, first, capacity - room)
            group[1] -= times
            if not group[1]:
                rooms[room].pop()
            if room > n:
                rooms[room - n].append([first, times])
    return runs, sequences


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = dict(docs.dtypes)["doc_id"]
    cutter = _pieces(tokenizer or default_tokenizer(), capacity, end_id)
    pieces = docs.select("doc_id", "text").mapInArrow(cutter, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    buckets = partitions(spark)
    pieces = scratch.save(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    sizes = scratch.save(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "sizes")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    runs, _ = plan(counts, capacity)
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    # the table of prefix sums grows with the buckets, so it is never broadcast
    ranked = ranked.join(before.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("r") - 1).drop("before", "r", "bucket")
    return ranked.mapInArrow(_placer(runs), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _placer(runs: list[tuple[int, int, int, int, int]]):
    """Looks a piece's rank up in the plan, which holds no more runs than patterns and residual lengths allow."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = int(table[:, 2].sum()) + 1 if len(table) else 1
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(keys, length * base + rank, side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(table[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
