"""Near-duplicate passages by an exact similarity join of content-defined paragraphs.

A paragraph is a run of WORDS words of a text, wherever its lines break. It begins where the hash of a five-word shingle is the
least among SPAN beginnings in a row, so equal passages are cut alike whatever stands around them: any passage of WORDS +
SPAN - 1 = 34 words that two texts share word for word (A-Z lower-cased) holds a whole paragraph of both. A text with
fewer beginnings has one paragraph, where the least of them is; one of fewer than WORDS words has none.

A paragraph's set is that of its five-word shingles, GRAMS at most. Two sets with 80 percent of their union in common differ by
at most three shingles: 10 d <= a + b + d <= 32 + d, where d counts what only one of them has. Keys that every such pair shares:

* Where no three words in a row come twice in one of them, what the other has of it is one run: two runs would have shingles
  between them that only the other has, of which it has one at most, and that would make three words come twice. So the two
  have a run of all but two shingles in common (of all but one, unless the other begins and ends with one shingle).
* Where three words in a row come twice in both: of four parts into which a hash deals the shingles, one is the same in both.

How it runs:

1. Keys travel as blobs by bucket of the key, each once for a block of texts, and only those of keys that come
   twice come out as rows. What several paragraphs of one block share is known there and never meets in one task.
2. The texts are read again for the paragraphs in question: their places and, once for a task and only where several
   sets share a key, their sets. Filters of at most 2**MOST_BITS bits say which these may be; beyond what they hold well
   they let more through, and joins decide.
3. What two near sets have in common is what is left of either without one shingle or none, or without two or three where the
   other is smaller; where no three words come twice, without shingles at the ends. So the sets in question meet by what is left of them, each with the one that left out the least (then
   with the most copies): that one is near all that are near each other there. Pairs are checked by the exact Jaccard
   similarity of their whole sets. So comparisons grow with the number of paragraphs, never with pairs of a group, and no
   link is lost. Components of the links are the classes. Paragraphs that overlap in
   the one text that has them don't link.

Of each class the first occurrence, by doc_id and place, is the keeper and the others are removals, but for those that overlap
a keeper, their own or another class's, in the same document: they stay as well. So no removal touches a keeper, and
whatever lies wholly inside the removals of equal paragraphs is still there once in the keepers.

Defined cases: null, empty and short texts have no rows. A paragraph that occurs again in its own document is a repeat
as well. Rows that repeat a doc_id and text stay or go together; places of different texts with one doc_id count as those of
one document. Documents without an id come last, and where all of a class have none, nothing of it is removed. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .ngram_join import _SIX, long_ids, short_ids
from .scratch import Scratch, hot_join
from .text import Texts, _powers, column_bytes, chunks, mix

WORDS, SPAN, WIDTH, PERCENT = 20, 15, 5, 80
#: Shingles of a paragraph; parts of a set, ways to deal them out, and shingles of a part that is a key of its own.
GRAMS = WORDS - WIDTH + 1
PARTS, DEALS, LEAST = 4, 4, 2
#: Sets of so many shingles or fewer differ from near ones by one shingle at most, if one of them is smaller still.
SMALL = 8
#: Words in a row that may make a paragraph repeat itself; shingles of a run that is a key; keys of a paragraph, or so.
TWICE, RUN, KEYS = 3, GRAMS - 2, 4
#: Paragraphs in a block of the index, band keys in a bucket, least and most bits of the filter by powers of two.
BLOCK, BUCKET_KEYS, LEAST_BITS, MOST_BITS = 1 << 18, 1 << 21, 20, 28
_U = np.uint64
_FACTORS = mix(np.arange(1, DEALS + 2)) | _U(1)


class _Runs:
    """A hash of the ``width`` entries from each position asked for, from prefix sums."""

    def __init__(self, hashes: np.ndarray, width: int):
        up, self.down = _powers(len(hashes) + 1)
        self.width = width
        with np.errstate(over="ignore"):
            self.total = np.concatenate(([_U(0)], np.cumsum(hashes * up[: len(hashes)], dtype=_U)))

    def __call__(self, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[at + self.width] - self.total[at]) * self.down[at] + _U(self.width))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each position on; the last width - 1 positions see fewer."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Paragraphs:
    """The paragraphs of some texts, by text and place."""

    def __init__(self, texts: Texts):
        self.texts = texts
        words = texts.word_hashes()
        self.grams, bounds = texts.windows(words, WIDTH)
        m = np.maximum(texts.counts - WORDS + 1, 0)  # beginnings of each text
        cuts = np.concatenate(([0], np.cumsum(m)))
        shift = np.repeat(bounds[:-1] - cuts[:-1], m)  # from beginnings to shingles
        order = mix(self.grams[np.arange(cuts[-1]) + shift])
        chosen = np.zeros(cuts[-1] + 1, dtype=bool)
        if cuts[-1]:
            own = np.repeat(np.arange(len(m)), m)
            width = np.minimum(m, SPAN)
            last = np.arange(cuts[-1]) + width[own] <= cuts[1:][own]  # windows inside one text
            whole = np.flatnonzero(last & (width[own] == SPAN))
            if len(whole):
                low = _least(order, SPAN)
                for k in range(SPAN):  # the first least one of each window
                    hit = order[whole + k] == low[whole]
                    chosen[whole[hit] + k] = True
                    whole = whole[~hit]
            for i in np.flatnonzero((m > 0) & (m < SPAN)):
                chosen[cuts[i] + int(order[cuts[i] : cuts[i + 1]].argmin())] = True
        at = np.flatnonzero(chosen[:-1])
        self.of = np.searchsorted(cuts, at, side="right") - 1
        self.gram = at + shift[at]  # the first shingle
        self.word = self.gram - bounds[self.of] + texts.first[self.of]  # the first word
        self.words = words
        self.keys = _Runs(words, WORDS)(self.word)
        # three words in a row that come twice within the length of a paragraph, and the paragraphs that hold the second
        threes, cuts = texts.windows(words, TWICE)
        again = np.zeros(len(threes) + 1, dtype=np.int64)
        for k in range(1, WORDS - TWICE + 1):
            again[k + 1 :] |= threes[k:] == threes[:-k]
        again = np.cumsum(again)
        first = self.word - texts.first[self.of] + cuts[self.of]
        self.plain = again[first + WORDS - TWICE + 1] == again[first]

    def __len__(self) -> int:
        return len(self.keys)

    def sets(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of shingles for each of some paragraphs, and which of them count: of equal ones the first."""
        rows = np.sort(self.grams[self.gram[at, None] + np.arange(GRAMS)], axis=1)
        live = np.ones(rows.shape, dtype=bool)
        live[:, 1:] = rows[:, 1:] != rows[:, :-1]
        return rows, live

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the paragraph that each is of; paragraphs whose sets are near have one in common.

        All have keys of their runs, and those that repeat themselves keys of parts. A part with fewer than LEAST shingles says little: who has one is dealt out anew instead, and at last has keys of any
        parts. Small sets have keys of what is left without one shingle or none.
        """
        whole = np.flatnonzero(~self.plain)
        rows, live = self.sets(whole)
        size = live.sum(axis=1)
        run, every = _Runs(self.words, RUN + WIDTH - 1), np.arange(len(self))
        keys, owner = [run(self.word + k) for k in range(GRAMS - RUN + 1)], [every] * (GRAMS - RUN + 1)

        def add(values: np.ndarray, of: np.ndarray, tag: int) -> None:
            with np.errstate(over="ignore"):
                keys.append(mix(values + mix(np.full(1, tag))))
            owner.append(whole[of])

        with np.errstate(over="ignore"):
            at = np.flatnonzero(size >= SMALL)
            for deal in range(DEALS):
                h = mix(rows[at] * _FACTORS[deal])
                part, on = h >> _U(62), live[at]
                weak = np.zeros(len(at), dtype=bool)
                for p in range(PARTS):
                    inside = on & (part == _U(p))
                    few = inside.sum(axis=1) < LEAST
                    weak |= few
                    use = np.flatnonzero(~few) if deal < DEALS - 1 else np.arange(len(at))
                    add(np.where(inside[use], h[use], _U(0)).sum(axis=1), at[use], deal * PARTS + p)
                at = at[weak]
            at = np.flatnonzero(size <= SMALL)
            h = np.where(live[at], mix(rows[at] * _FACTORS[DEALS]), _U(0))
            total = h.sum(axis=1)
            add(total, at, -1)
            for k in range(GRAMS):
                use = np.flatnonzero(live[at, k] & (size[at] > 1))
                add(total[use] - h[use, k], at[use], -1)
        return np.concatenate(keys), np.concatenate(owner)


def _paragraphs(column: pa.Array) -> Iterator[tuple[int, int, Paragraphs]]:
    data, offsets = column_bytes(column)
    for i, j in chunks(offsets):
        found = Paragraphs(Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        if len(found):
            yield i, j, found


_INDEX = "bucket int, keys binary, sets binary, told binary"


def _index(buckets: int):
    """Band keys by bucket: key and set of each; told: the collision is known already (1), the
    entry speaks for such (2), or it overlaps the one before in its text, so that both count as one (3)."""

    def block(sets: list[np.ndarray], bands: list[np.ndarray], owners: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sets_, first, copies = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
        keys, owner = np.concatenate(bands), np.concatenate(owners)
        place = np.full(sum(map(len, sets)), -1)
        place[first] = np.arange(len(first))
        owner = place[owner]
        keys, owner = keys[owner >= 0], owner[owner >= 0]
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(begin, len(keys)))
        # paragraphs that overlap in the one text that has them are no collision
        (text, word), least, most = np.concatenate(places, axis=1)[:, first][:, owner], np.minimum.reduceat, np.maximum.reduceat
        own = (least(text, begin) == most(text, begin)) & (most(word, begin) - least(word, begin) < WORDS) & (most(copies[owner], begin) == 1)
        many, alone = np.repeat((size > 1) & ~own, size), np.repeat((size > 1) & own, size)
        lead = np.zeros(len(keys), dtype=bool)
        lead[begin] = True
        # sets with copies are candidates by any one of their keys
        known = many | (copies > 1)[owner]
        parts = ((keys % _U(buckets)).astype(np.int32), np.where(known & lead, 2, np.where(lead, 0, 3)).astype(np.uint8), lead | alone), ((mix(sets_[owner]) % _U(buckets)).astype(np.int32), np.ones(len(keys), np.uint8), known)
        for bucket, told, use in parts:
            use = np.flatnonzero(use)
            use = use[np.argsort(bucket[use], kind="stable")]
            cuts = np.searchsorted(bucket[use], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            blob = lambda x: pa.array([x[use[cuts[b] : cuts[b + 1]]].tobytes() for b in full], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blob(keys), blob(sets_[owner]), blob(told)], ["bucket", "keys", "sets", "told"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bands, owners, places, held, texts = [], [], [], [], 0, 0
        for batch in batches:
            for i, j, found in _paragraphs(batch.column(0)):
                keys, owner = found.bands()
                sets.append(found.keys)
                bands.append(keys)
                owners.append(owner + held)
                places.append(np.stack([found.of + texts, found.word]))
                held, texts = held + len(found), texts + j - i
                if held >= BLOCK:
                    yield from block(sets, bands, owners, places)
                    sets, bands, owners, places, held = [], [], [], [], 0
        if held:
            yield from block(sets, bands, owners, places)

    return run


def _collisions(table: pa.Table) -> pa.Table:
    """For one bucket: the keys that come from several blocks or collide inside one, with their sets."""
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
    keys, sets, told = joined("keys", "<u8"), joined("sets", "<u8"), joined("told", "u1")
    away = told != 1
    _, inverse = np.unique(keys[away], return_inverse=True)
    counts = np.bincount(inverse, weights=told[away] != 3)
    keep = ~away
    keep[away] = (counts[inverse] > 1) & (told[away] != 2)
    return pa.table([pa.array(sets[keep].view(np.int64)), pa.array(keys[keep].view(np.int64))], ["s", "sig"])


def _spots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.view(_U))
    return (h >> _U(64 - bits)).astype(np.int64), (mix(h) >> _U(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame) -> tuple[int, bytes]:
    """A Bloom filter of two hashes over the column s of keys: its bits as a power of two (eight for a key, within the bounds) and its bytes.

    Executors make pieces of 2**18 bits; at most 2**MOST_BITS bits reach the driver.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_spots(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 18).astype(np.int32)), pa.array((at & 0x3FFFF).astype(np.int32))], ["part", "spot"])

    def piece(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 18, dtype=bool)
        out[table.column("spot").to_numpy()] = True
        return pa.table([table.column("part").slice(0, 1), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    whole = np.zeros((1 << (bits - 18), 1 << 15), dtype=np.uint8)
    for r in keys.select("s").mapInArrow(spots, "part int, spot int").distinct().groupBy("part").applyInArrow(piece, "part int, bits binary").toLocalIterator():
        whole[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits, whole.tobytes()


_FOUND = "text long, start long, end long, word long, s long, ids binary, plain boolean"


def _passes(held: tuple[int, bytes], keys: np.ndarray) -> np.ndarray:
    bits, packed = held
    table = np.frombuffer(packed, dtype=np.uint8)
    a, b = _spots(keys, bits)
    return (table[a >> 3] >> (a & 7) & table[b >> 3] >> (b & 7) & 1).astype(bool)


def _in_order(grams: np.ndarray) -> bytes:
    """As short_ids, in the order of the paragraph."""
    return (mix(grams) & _SIX).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _find(held):
    """Places of the paragraphs that the first filter lets through; sets of those that pass the second, once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, compared = held.value
        given: set[int] = set()
        for batch in batches:
            for i, j, found in _paragraphs(batch.column(1)):
                use = np.flatnonzero(_passes(repeats, found.keys))
                if not len(use):
                    continue
                texts, keys = found.texts, found.keys[use]
                lead = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
                base = lead[texts.offsets[found.of[use]]]
                start, end = lead[texts.starts[found.word[use]]] - base, lead[texts.ends[found.word[use] + WORDS - 1]] - base
                ids = [None] * len(use)
                for k in np.flatnonzero(_passes(compared, keys)).tolist():
                    if (key := int(keys[k])) not in given:
                        given.add(key)
                        at = found.gram[use[k]]
                        grams = found.grams[at : at + GRAMS]
                        ids[k] = _in_order(grams) if found.plain[use[k]] else short_ids(np.unique(grams))
                word = found.word[use] - texts.first[found.of[use]]
                of = pa.array(i + found.of[use])
                columns = [batch.column(0).take(of), batch.column(2).take(of), pa.array(start), pa.array(end), pa.array(word), pa.array(keys.view(np.int64)), pa.array(ids, pa.binary()), pa.array(found.plain[use])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "start", "end", "word", "s", "ids", "plain"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, cx), (y, cy) = (column_bytes(batch.column(k)) for k in (2, 3))
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            p, q = (long_ids(z[c[i] : c[i + 1]]) for z, c in ((x, cx), (y, cy)))
            same = len(np.intersect1d(p, q, assume_unique=True))
            keep[i] = 100 * same >= PERCENT * (len(p) + len(q) - same)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each set (s, ids, plain, others) without none or one of its shingles and, as bits of ``others`` tell
    that there are smaller sets, two or three, at the ends only where it is plain: s, gone, left."""
    ends = {0: [()], 1: [(0,), (GRAMS - 1,)], 2: [(0, 1), (0, GRAMS - 1), (GRAMS - 2, GRAMS - 1)], 3: []}
    for batch in batches:
        data, cuts = column_bytes(batch.column(1))
        s, plain, others, size = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), np.diff(cuts) // 6
        for n, simple in {*zip(size.tolist(), plain.tolist())}:
            alike = np.flatnonzero((size == n) & (plain == simple))
            for at in np.split(alike, range(1000, len(alike), 1000)):
                h = mix(np.stack([long_ids(data[cuts[i] : cuts[i + 1]]) for i in at]))
                has = lambda k: (others[at] >> max(n - k, 0) & 1).astype(bool)  # noqa: B023, E731
                all_, out = np.ones(len(at), dtype=bool), []
                with np.errstate(over="ignore"):
                    total = h.sum(axis=1)
                    for gone, use in ((0, all_), (1, all_), (2, has(2) | has(1) & (n >= 14)), (3, has(3))):
                        use = np.flatnonzero(use)
                        for c in (ends[gone] if simple else combinations(range(n), gone)) if len(use) and (n >= 5 or not gone) else ():
                            out.append((s[at[use]], mix(total[use] - h[use][:, list(c)].sum(axis=1) + _U(n - gone)), gone))
                gone = np.repeat(np.array([g for *_, g in out], dtype=np.int32), [len(x) for x, *_ in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, *_ in out])), pa.array(gone), pa.array(np.concatenate([y for _, y, _ in out]).view(np.int64))], ["s", "gone", "left"])


def _stars(sigs: DataFrame, sets: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets of which the same is left, where b left out the least; sets of which sigs says that they share a key."""
    # sizes of the sets that a set shares keys with, as bits
    size = sets.select("s", F.expr("shiftleft(1, cast(octet_length(ids) / 6 as int))").alias("bit"))
    group = sigs.join(size, "s").groupBy("sig").agg(F.bit_or("bit").alias("others"), F.count("*").alias("k"))
    group = scratch.save(group, "sizes")
    others = hot_join(sigs, group, ["sig"], "k", sigs.count()).groupBy("s").agg(F.bit_or("others").alias("others"))
    left = scratch.save(sets.join(others, "s").select("s", "ids", "plain", "others").mapInArrow(_left, "s long, gone int, left long"), "left")
    many = left.groupBy("left").agg(F.count("*").alias("k"), F.min("gone").alias("gone")).where("k > 1 and gone < 2")
    left = scratch.save(left.join(many.select("left"), "left", "left_semi").join(units.select("s", "copies", "first.text", "first.word"), "s"), "left-again")
    # paragraphs that overlap in the one text that has them are no repeats
    own = (F.min("text") == F.max("text")) & (F.max("word") - F.min("word") < WORDS) & (F.sum("copies") == F.count("*"))
    centre = left.groupBy("left").agg(F.max(F.struct(-F.col("gone"), "copies", "s")).alias("c"), F.count("*").alias("k"), own.alias("own")).where("not own")
    centre = scratch.save(centre.select("left", F.col("c.s").alias("b"), "k"), "centre-left")
    return hot_join(left.select("s", "left"), centre, ["left"], "k", left.count()).where("s <> b").select(F.col("s").alias("a"), "b").distinct()


def _links(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    left, right = (sets.select(F.col("s").alias(k), F.col("ids").alias(n)) for k, n in (("a", "x"), ("b", "y")))
    centre = scratch.save(pairs.groupBy("b").agg(F.count("*").alias("k")).join(right, "b"), "centre")
    return hot_join(pairs, centre, ["b"], "k", pairs.count()).join(left, "a").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each occurrence of a paragraph that repeats: doc_id, start, end (code points), n_words, kept_doc_id and
    kept_start (of the occurrence that stays), class_id, copies, removed."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    kind = dict(docs.dtypes)["doc_id"]
    # a paragraph for every ten words or so, of six bytes
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(12, min(1 << 23, -(-KEYS * size // 60 // BUCKET_KEYS)))
    sigs = docs.select("text").mapInArrow(_index(buckets), _INDEX).groupBy("bucket").applyInArrow(_collisions, "s long, sig long")
    sigs = scratch.save(sigs.distinct(), "sigs")
    repeats = scratch.save(sigs.select("s").distinct(), "repeats")
    shared = scratch.save(sigs.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    sigs = sigs.join(shared.select("sig"), "sig", "left_semi")  # from here on only keys that compare something
    compared = scratch.save(sigs.select("s").distinct(), "compared")
    held = spark.sparkContext.broadcast((key_filter(repeats), key_filter(compared)))
    found = scratch.save(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(_find(held), f"doc_id {kind}, {_FOUND}"), "found")
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "start", "word", "text")
    units = scratch.save(found.groupBy("s").agg(F.min(place).alias("first"), F.count("*").alias("copies")).join(repeats, "s", "left_semi"), "units")
    sets = scratch.save(found.where("ids is not null").select("s", "ids", "plain").join(compared, "s", "left_semi").dropDuplicates(["s"]), "sets")
    sigs = scratch.save(sigs, "shared-sigs")
    stars = scratch.save(_stars(sigs, sets, units, scratch), "stars")
    links = scratch.save(_links(stars, sets, scratch), "links")
    labels = connected_components(links, scratch, "classes-of")
    named = units.select("s", "first", "copies").join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("class_id", F.coalesce("label", "s"))
    whole = named.groupBy("class_id").agg(F.min("first").alias("keeper"), F.sum("copies").alias("copies")).where("copies > 1")
    classes = scratch.save(named.select("s", "class_id", F.col("copies").alias("own")).join(whole, "class_id"), "classes")
    scratch.keep("found", "classes")
    rows = hot_join(found.select("doc_id", "start", "end", "word", "s"), classes, ["s"], "own", found.count())
    stays = F.col("keeper.doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("start") == F.col("keeper.start"))
    # keepers by document and stretch of WORDS words; each touches two stretches, and a stretch has few different ones
    stretch = F.floor(F.col("word") / WORDS)
    kept = classes.where("keeper.doc_id is not null").select("keeper.doc_id", "keeper.word").distinct()
    kept = kept.select("doc_id", "word", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    kept = scratch.save(kept.groupBy("doc_id", "stretch").agg(F.collect_set("word").alias("kept")), "kept")
    touched = F.exists("kept", lambda k: F.abs(k - F.col("word")) < WORDS)
    whole = rows.withColumn("stretch", stretch).join(kept, ["doc_id", "stretch"], "left")
    return whole.select("doc_id", "start", "end", F.lit(WORDS).alias("n_words"), F.col("keeper.doc_id").alias("kept_doc_id"), F.col("keeper.start").alias("kept_start"), "class_id", "copies", (~stays & ~F.coalesce(touched, F.lit(False))).alias("removed"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
