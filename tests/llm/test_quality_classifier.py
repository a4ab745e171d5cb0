import random

import numpy as np

from quarry.llm import quality_classifier as q


def test_grades_are_ordered_and_held_out(spark):
    r = random.Random(3)
    rows, ratings = [], []
    for i in range(1600):
        g = i % 4  # four grades: the more junk the lower
        rows.append((i, " ".join(f"w{r.randrange(4000)}" + ("$$$" if r.random() < (3 - g) / 3 else "") for _ in range(r.randrange(20, 90)))))
        if i % 3:
            ratings.append((i, g))
    rows += [(7001, None), (7002, ""), (7003, "W! " * 40_000), (7003, "x")]
    docs = spark.createDataFrame([(*a, "t") for a in rows], "doc_id long, text string, tail string").repartition(3)
    table = spark.createDataFrame(ratings + [(None, 2), (4, None)], "doc_id long, grade int")
    got = {}
    for x in q.grade_documents(docs, table, q.F.col("grade"), grades=4, least=2).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows)
    test = [i for i in range(0, 1600, 3)]
    means = [np.mean([got[i][0].expected_grade for i in test if i % 4 == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2
    right = np.mean([(got[i][0].tail >= 0.5) == (i % 4 >= 2) for i in test])
    assert right > 0.93
    assert np.mean([got[i][0].kept for i in test if i % 4 >= 2]) > 0.95
    assert not got[7001][0].kept and not got[7002][0].kept


def test_thresholds_stay_ordered():
    m = q.Ordinal(5)
    m.gaps = np.array([-3.0, 0.2, 1.0])
    assert (np.diff(m.thresholds) > 0).all()


def test_slopes_are_those_of_the_likelihood():
    m = q.Ordinal(4)
    m.base, m.gaps = -0.7, np.array([0.3, -0.4])

    def log_likelihood(score, thresholds, y):
        """The chance of a grade as a difference of two tails, spelled out."""
        tail = [1.0] + [1 / (1 + np.exp(t - score)) for t in thresholds] + [0.0]
        return np.log(tail[y] - tail[y + 1])

    for score in (-2.0, 0.1, 1.7):
        tails = m.tails(np.array([score]))[0]
        assert (np.diff(tails) < 0).all()
        for y in range(4):
            t = m.thresholds
            got = m.slopes(score, y)
            for k in range(3):
                step = np.eye(3)[k] * 1e-6
                assert abs(got[k] - (log_likelihood(score, t + step, y) - log_likelihood(score, t - step, y)) / 2e-6) < 1e-6
            by_score = (log_likelihood(score + 1e-6, t, y) - log_likelihood(score - 1e-6, t, y)) / 2e-6
            assert abs(-got.sum() - by_score) < 1e-6


def test_features_and_scores_equal_plain_loops():
    """Each word's feature weighs 1 / sqrt(words), each shape 3 / words, for each time it occurs; a text's score is their sum."""
    texts = ["a b a", "", "x!! x!! $9 Zz", "lone"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    t = q.Texts(np.frombuffer(data, np.uint8), offsets)
    index, value, bounds = q.features(t)
    m = q.Ordinal(3)
    m.w = np.random.default_rng(1).normal(size=len(m.w)).astype(np.float32)
    scores = m.score(index, value, bounds)
    half = 1 << (q.BITS - 1)
    for k, text in enumerate(texts):
        words = text.split()
        own_index, own_value = index[bounds[k] : bounds[k + 1]], value[bounds[k] : bounds[k + 1]]
        assert abs(scores[k] - sum(float(m.w[i]) * float(v) for i, v in zip(own_index, own_value))) < 1e-4
        # a feature for each distinct word, of one value each; shapes count up to 3, stutters on top
        assert (own_index < half).sum() == len(set(words))
        assert np.allclose(own_value[own_index < half], 1 / np.sqrt(max(1, len(words))))
        shapes = own_value[(own_index >= half) & (own_index != 2 * half - 1)].sum()
        assert abs(shapes - (3 if words else 0)) < 1e-5
        stutter = sum(a == b for a, b in zip(words, words[1:]))
        assert abs(own_value[own_index == 2 * half - 1].sum() - 3 * stutter / max(1, len(words))) < 1e-5


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in q.grade_documents(docs, none, q.label_grade()).collect()} == {1: True, 2: False}
    assert q.grade_documents(docs.limit(0), none, q.label_grade()).collect() == []


def test_grades_outside_of_the_range_count_as_its_ends(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"w{r.randrange(50)}" + ("$$" if i % 2 else "") for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wild = spark.createDataFrame([(i, -4 if i % 2 else 9) for i in range(60)], "doc_id long, grade int")
    plain = spark.createDataFrame([(i, 0 if i % 2 else 2) for i in range(60)], "doc_id long, grade int")
    got, want = ([tuple(x) for x in q.grade_documents(docs, t, q.F.col("grade")).orderBy("doc_id").collect()] for t in (wild, plain))
    assert got == want
