import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives
from quarry.llm.hard_negatives import mine_hard_negatives, scores

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, row int, id string"


def plain(rows, positives=5, negatives=5):
    """Rows by the definition: (vec_id, embedding, label, is an anchor)."""
    kept = []
    for vec_id, x, label, query in rows:
        if vec_id is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, [int(np.floor(256 * float(np.float32(c)))) for c in x], label, query))
    out = []
    for i, (a, x, own, query) in enumerate(kept):
        if not query:
            continue
        found = [(-sum(p * q for p, q in zip(x, y)), b, label) for j, (b, y, label, _) in enumerate(kept) if j != i and len(x) == len(y)]
        for high, p, _ in sorted(r for r in found if r[2] == own)[:positives]:
            fits = sorted(r for r in found if r[2] != own and 80 * -high <= 100 * -r[0] <= 100 * -high)[:negatives]
            out += [(a, p, k + 1, n, -high, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(v, x, label, "x" if query else None, 1, "y") for v, x, label, query in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("anchor") == "x").collect())


def random_rows(seed, n, width=6, labels=4, cells=3):
    """Coarse components, so that scores tie."""
    r = random.Random(seed)
    rows = [(i, [r.randrange(-1, cells) / 4 for _ in range(width)], r.randrange(labels), i % 7 == 0) for i in range(n)]
    rows[3] = (3, None, 1, True)
    rows[4] = (4, [0.5, None] + [0.0] * (width - 2), 1, False)
    rows[5] = (5, [0.5, float("nan")] + [0.0] * (width - 2), 1, True)
    rows[6] = (6, [float("-inf")] * width, 1, False)
    rows[8] = (8, rows[8][1], None, True)
    rows[9] = (None, rows[9][1], 1, False)
    rows[10] = (10, [1.0, 1.0], 1, True)
    rows[11] = (11, [1.0, 0.75], 1, False)
    rows[12] = (12, [0.75, 1.0], 2, False)
    return rows + rows[20:24] + [(7, rows[7][1], rows[7][2], True)]  # repeated rows, an anchor too


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 3000)  # several blocks of anchors
    monkeypatch.setattr(hard_negatives, "SCORES", 64)
    rows = random_rows(seed, 90)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_no_rows_and_single_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1, True), (2, [1.0], 2, False)]) == []
    assert mined(spark, [(1, [], 1, True), (2, [], 1, False), (3, [], 2, False)]) == [(1, 2, 1, 3, 0, 0)]
    assert mined(spark, [(1, [1.0], 1, False), (2, [1.0], 2, False)]) == []


def test_copies_of_one_vector_tie_by_id(spark):
    rows = [(i, [0.5, 0.5], i % 2, i == 0) for i in range(60)]
    assert mined(spark, rows) == plain(rows)
    assert [r[3] for r in mined(spark, rows)[:5]] == [1, 3, 5, 7, 9]


def test_scores_are_exact_at_every_size():
    r = np.random.default_rng(5)
    for top in (200, 1 << 20, 1 << 25):
        a, b = r.integers(-top, top, (7, 9)), r.integers(-top, top, (11, 9))
        assert (scores(a, b) == np.array([[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a])).all()
    with pytest.raises(OverflowError):
        scores(np.full((1, 4), 1 << 30), np.full((1, 4), 1 << 30))
