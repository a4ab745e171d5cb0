import random
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import sharding as s


def lawful(got, rows, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for x in slots.values():
        assert sorted(x) == list(range(len(x)))


@pytest.mark.parametrize("hot", [0, 400, 1000])
def test_counts_slots_and_links(spark, hot):
    r = random.Random(hot)
    texts = [f"text {i}" for i in range(1000 - hot)] + ["hot"] * hot + [f"é{i // 5}" for i in range(400)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "text 7")]
    r.shuffle(rows)
    got = s.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", s.F.lit("x")).repartition(3), shards=10).collect()
    lawful(got, rows, 10)
    where = Counter((x.text_crc32, x.shard) for x in got)
    groups = Counter(x.text_crc32 for x in got)
    together = sum(max(n for (c, _), n in where.items() if c == g) == m for g, m in groups.items() if m == 5)
    if hot < 1000:
        assert together >= 72  # of the 80 groups of five
    if hot:
        quota = len(rows) // 10
        assert max(n for (c, _), n in where.items() if c == zlib.crc32(b"hot")) >= 0.8 * quota


def test_few_rows(spark):
    for n in (0, 1, 3, 12):
        rows = [(i % 5, "a" if i % 2 else f"b{i}") for i in range(n)]
        lawful(s.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect(), rows, 7)


def test_general_links(spark):
    """Links other than those of equal texts: two tangles of rows each end mostly in one shard."""
    scratch = s.Scratch(spark, "test")
    r = random.Random(2)
    links = {(a, b) for base in (0, 40) for a in range(base, base + 40) for b in r.sample(range(base, base + 40), 12) if b < a}
    rows = spark.range(400)
    placed = {x.id: x.shard for x in s.balanced_shards(rows, spark.createDataFrame(sorted(links), "a long, b long"), scratch, 5).collect()}
    cut = sum(placed[a] != placed[b] for a, b in links)
    assert cut < 0.4 * len(links)
    assert max(Counter(placed.values()).values()) - min(Counter(placed.values()).values()) <= 1


def plain(ids, links, start, bucket, shards, rounds):
    """Balanced label propagation by dictionaries: (shard, slot) of each id."""
    linked = {x for pair in links for x in pair}
    shard, still = dict(start), 0
    quota = [len(ids) // shards + (k < len(ids) % shards) for k in range(shards)]
    for turn in range(rounds):
        votes = defaultdict(Counter)
        for a, b in links:
            one, other = (a, b) if turn % 2 == 0 else (b, a)
            votes[one][shard[other]] += 1
        wants = defaultdict(list)
        for i, v in votes.items():
            best = max(v, key=lambda k: (v[k], -k))
            if best != shard[i] and v[best] > v[shard[i]]:
                wants[best].append(i)
        held = Counter(shard[i] for i in linked)
        moved = [(i, k) for k, w in wants.items() for i in sorted(w, key=lambda i: (bucket[i], i))[: max(0, quota[k] - held[k])]]
        shard.update(moved)
        still = 0 if moved else still + 1
        if still == 2:
            break
    rows = [sorted((i for i in ids if shard[i] == k), key=lambda i: (i not in linked, bucket[i], i)) for k in range(shards)]
    out = {i: (k, n) for k in range(shards) for n, i in enumerate(rows[k][: quota[k]])}
    free = [(k, n) for k in range(shards) for n in range(len(rows[k]), quota[k])]
    over = [i for k in range(shards) for i in rows[k][quota[k] :]]
    return out | dict(zip(over, free))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_propagation(spark, seed):
    r = random.Random(seed)
    n, shards = 300, 6
    links = {(a, b) for a in range(200) for b in r.sample(range(200), 2) if b < a} | ({(i, 7) for i in range(8, 150)} if seed == 3 else set())
    rows = spark.range(n)
    buckets = s.partitions(spark)
    known = rows.select("id", s.F.pmod(s.F.xxhash64("id", s.F.lit(1)), s.F.lit(shards)).alias("s"), s.F.pmod(s.F.xxhash64("id"), s.F.lit(buckets)).alias("b")).collect()
    want = plain(range(n), links, {x.id: x.s for x in known}, {x.id: x.b for x in known}, shards, 5)
    got = s.balanced_shards(rows, spark.createDataFrame(sorted(links), "a long, b long"), s.Scratch(spark, "test"), shards, 5)
    assert {x.id: (x.shard, x.slot) for x in got.collect()} == want
