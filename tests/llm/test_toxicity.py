import random
import zlib

import numpy as np
import pytest

from quarry.llm import toxicity as x

RUDE = ["blast", "rotter", "swine", "toad"]


def table(n=1500):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(RUDE) + r.choice(["", "!", ","]))
        rows.append((i, " ".join(words), r.choice(["en", "fr", None]), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = table()
    extra = [(9001, None, "en", "s"), (9002, "", None, "s"), (9003, "swine " + "calm words " * 30_000, "en", "s"), (9003, "x", "xx", "s"), (None, "y", "en", "s")]
    docs = spark.createDataFrame([(*a, 0.5) for a in rows + extra], "doc_id long, text string, lang string, source string, score double").repartition(3)
    labs = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = x.score_toxicity(docs, labs).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    right = total = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in truth:
            total += 1
            right += r.predicted == truth[r.doc_id]
    assert total > 200 and right >= 0.95 * total
    # the score has no inputs but the text: other languages and sources, the same scores
    other = docs.withColumns({"lang": x.F.lit("de"), "source": x.F.lit("z"), "score": x.F.lit(0.1)})
    scores = lambda rows: sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.score) for r in rows)
    for a, b in zip(scores(got), scores(x.score_toxicity(other, labs).collect()), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)  # sums of floats depend on batches


def test_too_little_to_learn(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in x.score_toxicity(docs, none).collect()] == [0.0, 0.0]
    assert x.score_toxicity(docs.limit(0), none).collect() == []


def test_batches_equal_single_texts():
    n = x.Network(1)
    r = np.random.default_rng(0)
    rows, counts = r.integers(0, 50, (40, 2)).astype(np.int32), np.array([3, 0, 1, 36])
    whole = n.logits(rows, counts)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    alone = [n.logits(rows[a:b], np.array([b - a]))[0] for a, b in zip(bounds, bounds[1:])]
    assert whole == pytest.approx(alone, abs=1e-5)


def plain_logit(n, rows):
    """A text's logit by loops over filters, windows and words."""
    words = [n.table[a].astype(float) + n.table[b] for a, b in rows] + [np.zeros(x.DIM)] * (max(x.WIDTHS) - 1 + (len(rows) == 0))
    total, k = -n.shift, 0
    for w, filt, bias in zip(x.WIDTHS, n.filters, n.bias):
        for f in range(x.FILTERS):
            best = max(sum(float(words[i + j] @ filt[j * x.DIM : (j + 1) * x.DIM, f]) for j in range(w)) for i in range(max(1, len(rows))))
            total += max(0.0, best + bias[f]) * n.out[k]
            k += 1
    return total


def test_logits_equal_plain_loops():
    n, r = x.Network(4), np.random.default_rng(1)
    n.shift = 0.3
    counts = np.array([0, 1, 2, 3, 17])
    rows = r.integers(0, 400, (counts.sum(), 2)).astype(np.int32)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    assert n.logits(rows, counts) == pytest.approx([plain_logit(n, rows[a:b]) for a, b in zip(bounds, bounds[1:])], abs=1e-5)


def test_gradients():
    """The gradients that training uses agree with finite differences of the loss."""
    n, r = x.Network(2), np.random.default_rng(3)
    n.filters, n.bias, n.out = [f.astype(float) for f in n.filters], [b.astype(float) for b in n.bias], n.out.astype(float)
    counts, labels, bias = np.array([4, 1, 9, 2]), np.array([1, 0, 0, 1]), 0.2
    e, bounds = n.embed(r.integers(0, 300, (counts.sum(), 2)).astype(np.int32), counts)
    e = e.astype(float) * 8

    def loss():
        z = n.pooled(e, bounds) @ n.out + bias
        decay = sum((f**2).sum() for f in n.filters) + (n.out**2).sum()
        return np.mean(np.log1p(np.exp(z)) - labels * z) + 0.5e-4 * decay

    def slope(array, at):
        held, step = array[at], 1e-5
        array[at] = held + step
        high = loss()
        array[at] = held - step
        low = loss()
        array[at] = held
        return (high - low) / (2 * step)

    _, grads, places, slopes = n.backward(e, bounds, labels, bias)
    params = [*n.filters, *n.bias, n.out]
    assert len(grads) == len(params)
    for p, g in zip(params, grads):
        for _ in range(12):
            at = tuple(int(r.integers(0, s)) for s in p.shape)
            assert g[at] == pytest.approx(slope(p, at), abs=2e-6)
    by_place = np.zeros_like(e)
    np.add.at(by_place, places, slopes)
    for at in ((0, 0), (3, 5), (bounds[2] + 4, 1), (bounds[2], 7)):
        assert by_place[at] == pytest.approx(slope(e, at), abs=2e-6)


def test_threshold_is_the_best():
    r = np.random.default_rng(5)
    for _ in range(20):
        labels = r.integers(0, 2, 30)
        labels[:2] = 0, 1
        logits, share = r.normal(labels, 1), 0.2
        weight = np.where(labels == 1, share / labels.sum(), (1 - share) / (30 - labels.sum()))

        def f1(t):
            over = logits > t
            return 2 * weight[over & (labels == 1)].sum() / (weight[over].sum() + share)

        got = x.best_threshold(logits, labels, share)
        assert f1(got) == pytest.approx(max(f1(t) for t in [logits.min() - 1, *logits[logits < logits.max()]]))


def test_thresholds_by_language(spark):
    rows, labels = table(1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = x.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    limits = {}
    langs = {i: lang for i, _, lang, _ in rows}
    for r in got:
        limits.setdefault(langs[r.doc_id], set()).add(r.lang_threshold)
        assert r.flagged == (r.score >= r.lang_threshold)
    assert all(len(v) == 1 and 0 < min(v) < 1 for v in limits.values()) and len(limits) == 3
