"""N-gram Jaccard join with token-combination prefixes.

Two texts link when the Jaccard similarity of their sets of distinct five-word shingles is at least ``percent`` / 100.
The join is exact up to collisions of 64-bit hashes (sets) and of 45 bits or more (tokens inside one pair).

How it runs, all by pre-aggregated blobs of hashes rather than a row for each shingle:

1. Every text becomes its set; equal sets are one class from there on.
2. An index over all shingles counts, for each, the sets that hold it (its *class*: in one set only, rare, frequent).
   A shingle that very many sets of one batch hold travels once, with its count.
3. A set whose shingles shared with any other set are too few to reach the similarity can link with nothing and goes.
   The others take a prefix in the order lone, rare, frequent. Rare shingles are indexed singly. Frequent ones fall
   into ``m`` subclasses by hash and are indexed by pairs inside a subclass; a subclass with c members costs c - 1 of
   the errors that the similarity allows, so the prefix is extended until these sum to more than the errors allowed.
   By the pigeonhole principle linked sets share an indexed signature. ``m`` depends on the band of sizes; a set is
   indexed in its own band and the next, which is where any partner of 0.8 to 1.25 times its size is.
4. Sets under one signature are compared with the most central of them, each first with the one it shares the most
   signatures with; then the other centres, where components differ still; then all members of a signature whose
   components still differ. So a group of many near copies costs comparisons in proportion to its size, and no link
   between different components is lost.
5. Comparisons are of whole sets. Components come from label propagation.

Defined cases: null or empty texts, and texts without words, have an empty set, which links with nothing (component:
their own id). Fewer than five words: the whole sequence is the one shingle. Rows that repeat a doc_id give a row
each; a null doc_id is kept and never becomes a component's id unless all of it is null. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .components import connected_components
from .scratch import Scratch
from .text import column_bytes, mix, shingle_sets, text_chunks

#: Sets that hold a shingle, from which it counts as frequent.
FREQUENT = 64
#: Shingles in a batch of the index, and in a bucket of it.
BATCH_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 21
_LOW = np.uint64((1 << 40) - 1)
_SIX = np.uint64((1 << 48) - 1)
_U = np.uint64


def set_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    n = np.diff(bounds)
    out = np.zeros(len(n), dtype=_U)
    full = np.flatnonzero(n)
    if len(full):
        with np.errstate(over="ignore"):
            total = np.add.reduceat(grams, bounds[:-1][full])
            parity = np.bitwise_xor.reduceat(grams, bounds[:-1][full])
            out[full] = mix(mix(total) + parity + n[full].astype(_U))
    return out


def least_size(percent: int) -> int:
    """The size from which a set can link with one that isn't equal: n of n + 1 shingles must be enough."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def size_bands(limit: int, percent: int) -> np.ndarray:
    """Least sizes of the bands: sizes that can link (0.8 to 1.25 times each other at 80 percent) are in one band or in two that adjoin."""
    out = [least_size(percent)]
    while out[-1] <= limit:
        out.append(-(-out[-1] * 100 // percent))
    return np.array(out)


def overlap_needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least shingles of a set of n that any linked set shares."""
    return -(-n * percent // 100)


def _pairs_of(ids: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids inside each class; ids ascend."""
    order = np.argsort(classes, kind="stable")
    ids, classes = ids[order], classes[order]
    left, right, d = [], [], 1
    while d < len(ids):
        same = np.flatnonzero(classes[d:] == classes[:-d])
        if not len(same):
            break
        left.append(ids[same])
        right.append(ids[same + d])
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])


def signatures(n: int, rare: np.ndarray, frequent: np.ndarray, percent: int, bands: np.ndarray) -> np.ndarray:
    """Signatures of a set of n shingles, of which these are shared with other sets; both ascend."""
    allowed = n - int(overlap_needed(n, percent))
    lone = n - len(rare) - len(frequent)
    if lone > allowed or n < least_size(percent):
        return np.empty(0, dtype=_U)
    out = [mix(rare[: allowed + 1 - lone])]
    need = allowed + 1 - lone - len(rare)
    if need > 0:
        own = int(np.searchsorted(bands, n, side="right")) - 1
        for band in (own, own + 1):
            m = int(overlap_needed(int(bands[max(band - 1, 0)]), percent)) - 1
            classes = mix(frequent) % _U(m)
            _, first = np.unique(classes, return_index=True)
            gain = np.ones(len(frequent), dtype=np.int64)
            gain[first] = 0
            q = int(np.searchsorted(np.cumsum(gain), need)) + 1
            a, b = _pairs_of(frequent[:q], classes[:q])
            with np.errstate(over="ignore"):
                out.append(mix(mix(a) + b * _U(0x9E3779B97F4A7C15) + _U(band + 1)))
    return np.unique(np.concatenate(out))


def _doc_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        s = np.zeros(batch.num_rows, dtype=_U)
        for i, j, texts in text_chunks(batch.column(1)):
            grams, bounds = shingle_sets(texts)
            n[i:j], s[i:j] = np.diff(bounds), set_keys(grams, bounds)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(s.view(np.int64))], ["doc_id", "mark", "n", "s"])


_INDEX = "bucket int, batch long, tokens binary, counts binary, hot binary, hot_counts binary, keys binary, sizes binary"


def _pack(low: np.ndarray) -> bytes:
    """Five bytes for each of the values below 2**40."""
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    out = np.zeros((len(part), 8), dtype=np.uint8)
    out[:, :5] = part
    return out.view("<u8").ravel()


def short_ids(ids: np.ndarray) -> bytes:
    """Six bytes for each token, ascending by them."""
    return np.sort(mix(ids) & _SIX).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def long_ids(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


def _index(buckets: int, frequent: int, percent: int):
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6

    def blobs(sets: list[np.ndarray], bounds: list[np.ndarray], turn: Iterator[int]) -> Iterator[pa.RecordBatch]:
        grams = np.concatenate(sets)
        sizes = np.concatenate([np.diff(b) for b in bounds])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        keys = set_keys(grams, offsets)
        _, first = np.unique(keys, return_index=True)
        keep = np.zeros(len(keys), dtype=bool)
        keep[first] = True
        keep &= sizes >= least_size(percent)
        if not keep.any():
            return
        grams, keys, sizes = grams[np.repeat(keep, sizes)], keys[keep], sizes[keep]
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        # the same when a lost task runs again, and never that of another batch, whatever they hold
        batch = TaskContext.get().partitionId() << 32 | next(turn)
        bucket = ((grams >> _U(40)) % _U(buckets)).astype(np.uint32)
        low = grams & _LOW
        # what very many sets of this batch hold goes once
        ranked = np.sort(grams)
        often = np.unique(ranked[frequent - 1 :][ranked[frequent - 1 :] == ranked[: len(ranked) - frequent + 1]]) if len(ranked) >= frequent else ranked[:0]
        at = np.searchsorted(often, grams)
        is_hot = np.zeros(len(grams), dtype=bool) if not len(often) else often[np.minimum(at, len(often) - 1)] == grams
        hot_counts = np.bincount(at[is_hot], minlength=len(often)).astype(np.uint32)
        hot_bucket = ((often >> _U(40)) % _U(buckets)).astype(np.uint32)
        cold = np.flatnonzero(~is_hot)
        order = cold[np.argsort(bucket[cold].astype(np.uint16) if buckets <= 1 << 16 else bucket[cold], kind="stable")]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows: list[list] = [[] for _ in names]
        for b in range(buckets):
            part, hot = order[cuts[b] : cuts[b + 1]], np.flatnonzero(hot_bucket == b)
            if len(part) or len(hot):
                for column, x in zip(rows, (b, batch, _pack(low[part]), np.bincount(owner[part], minlength=len(sizes)).astype("<u4").tobytes(), _pack(often[hot] & _LOW), hot_counts[hot].astype("<u4").tobytes(), None, None)):
                    column.append(x)
        own = np.flatnonzero(is_hot)
        ids = (bucket[own].astype(_U) << _U(40)) | low[own]
        for column, x in zip(rows, (int(mix(np.array([batch]))[0] % _U(buckets)), batch, None, np.bincount(owner[own], minlength=len(sizes)).astype("<u4").tobytes(), ids.astype("<u8").tobytes(), None, keys.astype("<u8").tobytes(), sizes.astype("<u4").tobytes())):
            column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bounds, held, turn = [], [], 0, count()
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0)):
                grams, offsets = shingle_sets(texts)
                sets.append(grams)
                bounds.append(offsets)
                held += len(grams)
                if held >= BATCH_TOKENS:
                    yield from blobs(sets, bounds, turn)
                    sets, bounds, held = [], [], 0
        if held:
            yield from blobs(sets, bounds, turn)

    return run


_SHARED = "batch long, bucket int, tokens binary, often binary, counts binary, hot binary, keys binary, sizes binary"


def _classify(frequent: int):
    """For one bucket of the index: of each batch, the shingles that two sets or more hold, and which are frequent."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        data = [r for r in rows if r["tokens"] is not None]
        tokens = [_unpack(r["tokens"]) for r in data]
        hot = [_unpack(r["hot"]) for r in data]
        weights = [np.frombuffer(r["hot_counts"], dtype="<u4") for r in data]
        out = []
        if data:
            every = np.concatenate(tokens + hot)
            order = np.argsort(every)
            ranked = every[order]
            new = np.empty(len(ranked), dtype=bool)
            new[:1] = True
            np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
            del ranked
            first = np.flatnonzero(new)
            del new
            held = np.concatenate([np.ones(sum(map(len, tokens)), dtype=np.uint32), *weights])
            # of each shingle the sets of all its entries
            total = np.add.reduceat(held[order], first, dtype=np.int64)
            sets = np.empty(len(every), dtype=np.int64)
            sets[order] = np.repeat(total, np.diff(np.append(first, len(every))))
            del order, every
            at = 0
            for r, t in zip(data, tokens):
                n = sets[at : at + len(t)]
                at += len(t)
                keep = n >= 2
                if keep.any():
                    counts = np.frombuffer(r["counts"], dtype="<u4")
                    owner = np.repeat(np.arange(len(counts)), counts)[keep]
                    out.append((r["batch"], r["bucket"], _pack(t[keep]), np.packbits(n[keep] >= frequent).tobytes(), np.bincount(owner, minlength=len(counts)).astype("<u4").tobytes(), None, None, None))
        out += [(r["batch"], -1, None, None, r["counts"], r["hot"], r["keys"], r["sizes"]) for r in rows if r["tokens"] is None]
        names = [x.split()[0] for x in _SHARED.split(", ")]
        kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 6
        return pa.table([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return run


_SETS = "s long, n long, lone long, shared long, ids binary, sigs array<long>"


def _assemble(percent: int):
    """For one batch: the sets that share enough with others, with their shared shingles and signatures."""

    def run(table: pa.Table) -> pa.Table:
        owners, ids, often, keys, sizes = [], [], [], None, None
        for r in table.to_pylist():
            counts = np.frombuffer(r["counts"], dtype="<u4")
            owners.append(np.repeat(np.arange(len(counts), dtype=np.int64), counts))
            if r["keys"] is None:
                low = _unpack(r["tokens"])
                ids.append(low | (_U(r["bucket"]) << _U(40)))
                often.append(np.unpackbits(np.frombuffer(r["often"], dtype=np.uint8), count=len(low)).astype(bool))
            else:
                keys, sizes = np.frombuffer(r["keys"], dtype="<u8"), np.frombuffer(r["sizes"], dtype="<u4").astype(np.int64)
                ids.append(np.frombuffer(r["hot"], dtype="<u8"))
                often.append(np.ones(len(ids[-1]), dtype=bool))
        owner, ids, often = np.concatenate(owners), np.concatenate(ids), np.concatenate(often)
        shared = np.bincount(owner, minlength=len(keys))
        alive = shared >= overlap_needed(sizes, percent)
        keep = alive[owner]
        owner, ids, often = owner[keep], ids[keep], often[keep]
        order = np.lexsort((ids, owner))
        owner, ids, often = owner[order], ids[order], often[order]
        bands = size_bands(int(sizes.max(initial=0)), percent)
        s, n, lone, held, blobs, sigs = [], [], [], [], [], []
        cuts = np.searchsorted(owner, np.arange(len(keys) + 1))
        for k in np.flatnonzero(alive):
            part, freq = ids[cuts[k] : cuts[k + 1]], often[cuts[k] : cuts[k + 1]]
            s.append(int(keys[k].view(np.int64)))
            n.append(int(sizes[k]))
            lone.append(int(sizes[k] - freq.sum()))
            held.append(len(part))
            blobs.append(short_ids(part))
            sigs.append(signatures(int(sizes[k]), part[~freq], part[freq], percent, bands).view(np.int64))
        return pa.table([pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(lone, pa.int64()), pa.array(held, pa.int64()), pa.array(blobs, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["s", "n", "lone", "shared", "ids", "sigs"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            (x, cx), (y, cy) = (column_bytes(batch.column(k)) for k in (4, 5))
            same = np.zeros(len(na), dtype=np.int64)
            for i in range(len(na)):
                p, q = (long_ids(z[c[i] : c[i + 1]]) for z, c in ((x, cx), (y, cy)))
                if len(q):
                    same[i] = (q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()
            linked = 100 * same >= percent * (na + nb - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same), pa.array(linked)], ["a", "b", "same", "linked"])

    return run


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with the size of their intersection and whether they link."""
    left = sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("ids").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("ids").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y")
    return both.mapInArrow(_verify(percent), "a long, b long, same long, linked boolean")


def resolve(sigs: DataFrame, sizes: DataFrame, fetch: Callable[[DataFrame], DataFrame], scratch: Scratch, percent: int) -> DataFrame:
    """Rows (node, label): sets with links, by key, and the least key of their component.

    sigs: s, n (size), lone (rank of its centrality, least first), sig, without repeats. sizes: s, shared (an upper bound of
    what it has in common with any other). fetch gives s, n, ids (sorted, 6 bytes each) of the sets s that it is asked for.
    """
    # a signature of one set only compares nothing
    centre = sigs.groupBy("sig").agg(F.min(F.struct("lone", "n", "s")).alias("c"), F.count("*").alias("k")).where("k > 1").select("sig", F.col("c.s").alias("hub"), F.col("c.n").alias("hub_n"), F.col("c.lone").alias("hub_lone"))
    sigs = scratch.save(sigs.join(centre, "sig"), "sigs")
    alike = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    stars = scratch.save(sigs.where(alike("n", "hub_n") & (F.col("s") != F.col("hub"))).groupBy(F.col("s").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("common"), F.min("hub_lone").alias("hub_lone")), "stars")
    used = stars.select(F.col("a").alias("s")).union(stars.select(F.col("b").alias("s"))).distinct()
    sets = fetch(used)
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("common", -F.col("hub_lone"), "b")).alias("b"))
    first = scratch.save(_compare(best, sets, percent), "seen-1")
    links = first.where("linked").select("a", "b")
    labels = connected_components(links, scratch, "round-1")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    rest = scratch.save(apart(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), labels), "rest-1")
    if rest.limit(1).count():
        links = links.union(scratch.save(_compare(rest, sets, percent), "seen-2").where("linked").select("a", "b"))
        labels = connected_components(links, scratch, "round-2")
    # signatures whose members are not all in one component: their members against each other
    la = labels.withColumnRenamed("node", "s")
    open_ = sigs.select("sig", "s", "n").join(la, "s", "left").withColumn("label", F.coalesce("label", "s"))
    mark = F.xxhash64("s")
    mixed = open_.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("k"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y")).where("low <> high")
    # of signatures with the same members one is enough
    mixed = mixed.groupBy("k", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    # what is known of each: the intersection with its own centre, and how much it shares outside of that
    known = first.select(F.col("a").alias("s"), F.col("b").alias("hub"), "same")
    open_ = open_.join(mixed, "sig", "left_semi").join(known, "s", "left").join(sizes, "s")
    every = open_.groupBy("s").agg(F.collect_set("sig").alias("sigs"))
    open_ = scratch.save(open_.join(every, "s").select("sig", "sigs", "s", "n", "label", F.coalesce("hub", "s").alias("hub"), F.coalesce("same", "shared").alias("same"), (F.col("shared") - F.coalesce("same", "shared")).alias("other")), "open")
    x, y = (open_.select("sig", *[F.col(c).alias(f"{c}_{k}") for c in ("s", "n", "label", "hub", "same", "other", "sigs")]) for k in "ab")
    # with one centre, an intersection is at most the lesser part inside it and the lesser part outside
    most = F.least("same_a", "same_b") + F.least("other_a", "other_b")
    can = (F.col("hub_a") != F.col("hub_b")) | (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    # a pair is made under the least signature that both have, and there only
    least = F.array_min(F.array_intersect("sigs_a", "sigs_b")) == x.sig
    pairs = x.join(y, (x.sig == y.sig) & (F.col("s_a") < F.col("s_b")) & (F.col("label_a") != F.col("label_b")) & alike("n_a", "n_b") & can & least).select(F.col("s_a").alias("a"), F.col("s_b").alias("b")).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = scratch.save(pairs.join(done, ["a", "b"], "left_anti"), "rest-2")
    if rest.limit(1).count():
        more = scratch.save(_compare(rest, fetch(rest.select(F.col("a").alias("s")).union(rest.select(F.col("b").alias("s"))).distinct()), percent), "seen-3").where("linked").select("a", "b")
        if more.limit(1).count():
            labels = connected_components(links.union(more), scratch, "round-3")
    return labels


def similar_sets(spark: SparkSession, docs: DataFrame, scratch: Scratch, total: int, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """Rows (node, label): sets with links, by key, and the least key of their component. total: of shingles."""
    buckets = max(32, min(1 << 23, -(-total // BUCKET_TOKENS)))
    index = docs.select("text").mapInArrow(_index(buckets, frequent, percent), _INDEX)
    shared = index.groupBy("bucket").applyInArrow(_classify(frequent), _SHARED)
    held = scratch.save(shared.groupBy("batch").applyInArrow(_assemble(percent), _SETS), "held")
    sigs = held.select("s", "n", "lone", F.explode("sigs").alias("sig")).distinct()

    def fetch(used: DataFrame) -> DataFrame:
        # sets that several batches hold are kept once
        return held.select("s", "n", "ids").join(used, "s", "left_semi").dropDuplicates(["s"])

    return resolve(sigs, held.select("s", "shared").distinct(), fetch, scratch, percent)


def _classes(docs: DataFrame, mark: Column, scratch: Scratch, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n, s) of docs, s being their sets' keys, and s, label (of its component), component_id of all sets."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = scratch.save(docs.select("doc_id", "text", mark.alias("mark")).mapInArrow(_doc_sets, f"doc_id {kind}, mark long, n long, s long"), "docs")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = rows.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    if not total:
        return rows, least.select("s", F.col("s").alias("label"), F.col("least").alias("component_id"))
    labels = similar_sets(spark, docs.select("text"), scratch, total, percent, frequent)
    named = least.join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = scratch.save(named.select("s", "label").join(ids, "label"), "classes")
    scratch.keep("docs", "classes")
    return rows, classes


def ngram_components(docs: DataFrame, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id. See the module for the rules."""
    rows, classes = _classes(docs, F.lit(0).cast("long"), Scratch(docs.sparkSession, "ngram-join"), percent, frequent)
    return rows.join(classes, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """One row of each component of docs, whole and unchanged; rows without words all stay.

    Decisions are about rows, not ids, so a text that shares its id with another's copy stays. The row with the least
    doc_id stays (rows without an id come last); of rows of that id in the component the one with the least set key and then
    the least hash of all columns, so nothing is left to chance; of rows equal in all columns one. Ids and hashes decide;
    texts are shuffled once, to meet the decisions.
    """
    scratch = Scratch(docs.sparkSession, "keep-first")
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows, classes = _classes(docs, mark, scratch, percent, frequent)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "s", "mark")
    chosen = rows.where("n > 0").join(classes.select("s", "label"), "s").groupBy("label").agg(F.min(order).alias("c"))
    ident = lambda c: (c.isNull().alias("no"), F.coalesce(c.cast("string"), F.lit("")).alias("id"))
    chosen = scratch.save(chosen.select(*ident(F.col("c.doc_id")), F.col("c.mark").alias("mark")), "chosen")
    scratch.keep("chosen")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *ident(F.col("doc_id")), mark.alias("mark"))
    key = ["no", "id", "mark"]
    found = whole.join(chosen.hint("merge"), key, "left_semi").dropDuplicates(key).select("row.*")
    return found.unionByName(docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
