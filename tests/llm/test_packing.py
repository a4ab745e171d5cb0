import random
import zlib
from collections import defaultdict

import numpy as np

from quarry.llm import packing as p


def check_plan(counts, capacity):
    runs, sequences = p.plan(counts, capacity)
    seen = defaultdict(list)
    ranks = defaultdict(list)
    for n, rank, times, first, offset in runs:
        for k in range(times):
            seen[first + k].append((offset, n))
            ranks[n].append(rank + k)
    assert len(seen) == sequences
    for x in seen.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    for n in range(1, capacity + 1):
        assert sorted(ranks[n]) == list(range(counts[n]))
    return sequences


def test_plans_are_whole_and_tight():
    r = np.random.default_rng(1)
    for capacity in (8, 31, 256):
        for total in (0, 1, 5, 400, 5000):
            lengths = np.clip(r.gamma(1.5, capacity / 5, total).astype(int) + 1, 1, capacity)
            counts = np.bincount(lengths, minlength=capacity + 1)
            n = check_plan(counts, capacity)
            least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
            assert n >= least
            if total >= 5000:
                assert n <= 1.01 * least + 1
    one = np.zeros(257, dtype=int)
    one[100] = 1001
    assert check_plan(one, 256) == 501


def test_ids_are_the_librarys():
    r = random.Random(3)
    coder = p.Encoder(p.default_tokenizer())
    bits = ["the", " ", "  ", "\n", "\n\n", "é", "ñandú", "12", "3.5", "'", "'s", "'ll", "$$$", "<|endoftext|>", "\t", " ", "…", "日本", "A", "!!", " x", " ", "ª", "²", "\x1c", "\x85", "😀"]
    texts = ["", " ", "\n", "a", " a ", "  a  b   ", "it's", "a 's 'LL"] + ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(1500)]
    for part in (texts, texts[::-1]):
        data = np.frombuffer("".join(part).encode(), dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in part])))
        for t, ids in zip(part, coder.encode(data, offsets)):
            assert ids.tolist() == coder.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()] + [(9001, None), (9002, ""), (9003, "é b " * 9000), (9003, "é b " * 9000)]
    got = p.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    library = p.Encoder(p.default_tokenizer()).library
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids), 2048), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        ends = [0]
        for a, n in sorted(x):
            assert a == ends[-1]
            ends.append(a + n)
        assert ends[-1] <= 2048
    assert len(bins) <= 1.01 * sum(x[3] for x in want) / 2048 + 2
    assert p.pack(spark.createDataFrame([], "doc_id long, text string, rank int")).collect() == []
