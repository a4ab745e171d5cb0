import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm import vector_codes
from quarry.llm.vector_codes import compress_vectors, nearest

SCHEMA = "vec_id long, embedding array<double>, label string, code int, _key string, error int"


def plain(rows):
    kept = [(i, [math.floor(4096 * c) for c in x], label) for i, x, label in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    if not kept:
        return []
    width = max(1, -(-max(len(x) for _, x, _ in kept) // 8))
    parts = [[(x + [0] * (8 * width - len(x)))[p * width : (p + 1) * width] for p in range(8)] for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:16]
    books = [[parts[i][p] for i in order] for p in range(8)]

    def assign(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        new = [[*b] for b in books]
        for p in range(8):
            held = {}
            for x in parts:
                held.setdefault(assign(p, x[p])[1], []).append(x[p])
            for e, members in held.items():
                new[p][e] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    sha = hashlib.sha256(",".join(str(z) for b in books for c in b for z in c).encode()).hexdigest()
    found = [[assign(p, x[p]) for p in range(8)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    whole = {}
    for (_, _, label), e in zip(kept, errors):
        whole[label] = whole.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, whole[label], sha) for (i, _, label), f, err in zip(kept, found, errors)), key=str)


def coded(spark, rows):
    df = spark.createDataFrame([(i, x, label, 1, "k", 2) for i, x, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in compress_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def random_rows(seed, n, width):
    r = random.Random(seed)
    rows = [(i, [r.randrange(-40, 40) / 100 for _ in range(width)], r.choice(["a", "b", None])) for i in range(n)]
    rows[2] = (2, None, "a")
    rows[3] = (3, [0.1] * (width - 1) + [None], "a")
    rows[4] = (4, [float("inf")] + [0.1] * (width - 1), "b")
    rows[5] = (None, rows[5][1], "b")
    return rows + rows[7:10]


@pytest.mark.parametrize("seed, n, width", [(1, 120, 16), (2, 60, 8), (3, 14, 24)])
def test_equals_the_definition(spark, seed, n, width, monkeypatch):
    monkeypatch.setattr(vector_codes, "COMPONENTS", 400)
    rows = random_rows(seed, n, width)
    assert coded(spark, rows) == plain(rows)


def test_odd_lengths_copies_and_empty_tables(spark):
    rows = [(i, [0.25 * (i % 3)] * (5 + i % 7), "a") for i in range(40)]
    assert coded(spark, rows) == plain(rows)
    same = [(i, [0.5] * 8, None) for i in range(30)]
    assert coded(spark, same) == plain(same)
    assert coded(spark, [(1, [], "a")]) == plain([(1, [], "a")])
    assert coded(spark, []) == [] and coded(spark, [(1, None, "a")]) == []


def test_partial_distances_find_the_first_nearest():
    r = np.random.default_rng(3)
    for _ in range(20):
        book, x = r.integers(-3, 4, (16, 4)), r.integers(-4, 5, (200, 4))
        d = np.square(x[:, None] - book[None]).sum(axis=2)
        code, best = nearest(x, book)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
