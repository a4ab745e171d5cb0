import random
import re

import pytest

from quarry.llm.ngram_join import ngram_components, op2_ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=80):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = text(60)
    out = []
    for _ in range(40):
        out.append(text(r.choice([1, 3, 5, 9, 30, 120])))
    base = text(150)
    for _ in range(120):  # near copies around a common base, some just above and some just below
        c = list(base)
        for _ in range(r.randrange(0, 6)):
            c[r.randrange(len(c))] = r.choice(vocabulary)
        out.append(c)
    for n in (12, 20, 33):
        b = text(n)
        for _ in range(30):
            c = list(b)
            c[r.choice([0, -1, r.randrange(n)])] = r.choice(vocabulary)
            out.append(c)
    for _ in range(80):  # a common passage in otherwise different texts
        out.append(text(r.randrange(5, 60)) + passage + text(r.randrange(5, 60)))
    rows = [(i, " ".join(x).replace("w1 ", "W1\t")) for i, x in enumerate(out)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, rows[0][1]), (1003, rows[0][1]), (1004, "a b c"), (1005, "A  b\nc")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [3, 64])
def test_against_brute_force(spark, frequent):
    rows = corpus(frequent)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), frequent=frequent)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_and_nulls(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, None), (7, "x" * 200_000)]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, s string, label int")
    got = sorted(map(tuple, ngram_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (None, 0, None), (7, 1, 7)], key=str)


def test_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op2_ngram_join(spark, d).collect())) == brute(rows)


def test_equal_partitions(spark):
    """Two files with the same texts, in the same and in another order: nothing is counted or given twice."""
    r = random.Random(4)
    base = [f"w{r.randrange(300)}" for _ in range(60)]
    texts = [" ".join(base), " ".join(base[:42] + [f"v{i}" for i in range(18)]), " ".join(f"u{i}" for i in range(50)), "one two three four five six seven eight nine ten"]
    for second in (texts, texts[::-1], texts[:1]):
        rows = list(enumerate(texts)) + [(10 + i, t) for i, t in enumerate(second)]
        whole = spark.createDataFrame(rows[: len(texts)], "doc_id long, text string").coalesce(1)
        whole = whole.unionAll(spark.createDataFrame(rows[len(texts) :], "doc_id long, text string").coalesce(1))
        assert sorted(map(tuple, ngram_components(whole).collect())) == brute(rows)


@pytest.mark.parametrize("percent", [51, 60, 75, 90, 100])
def test_other_thresholds(spark, percent):
    """Small sets too: of three shingles two, or of four three, can be enough."""
    r = random.Random(percent)
    rows = []
    for k in range(60):
        base = [f"v{r.randrange(12)}" for _ in range(r.choice([5, 6, 7, 8, 9, 12, 30]))]
        for _ in range(3):
            w = list(base)
            if r.random() < 0.6:
                w = w[: len(w) - r.randrange(3)] + [f"e{r.randrange(5)}"] * r.randrange(2)
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in ngram_components(df, percent, frequent=4).collect()) == brute(rows, percent)
    with pytest.raises(ValueError):
        ngram_components(df, 50)
