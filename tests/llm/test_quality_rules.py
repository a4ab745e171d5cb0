import random
import re
from collections import Counter
from math import comb

import numpy as np

from quarry.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def texts(seed=1):
    r = random.Random(seed)
    out = [None, "", "\n", " \n\n a", "\na\n", "a\na\n a\n", "é" * 30 + " ü|# \n", "x " * 50, "\n\nq w\nq w\n"]
    for _ in range(150):
        part = [r.choice("a b cé D! $% \n \n\n \t".split(" ") + ["\n", "ab\ncd"]) for _ in range(r.randrange(1, 120))]
        out.append(r.choice([" ", "  ", "\n"]).join(part) * r.choice([1, 1, 2]))
    return out


def test_counts_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    got = q.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t, _ in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_small_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = q.op10_quality_rules(spark, d).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == rows
    assert all(not r.kept for r in got if r.base_failed)


def test_binomial_is_exact():
    for n, p in ((20, 0.1), (57, 0.03)):
        for k in (0, 1, 3):
            assert abs(q.binomial_below(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_cutoffs_hold_the_risk():
    """In repeated draws the true risk of the chosen cutoff exceeds the limit in no more than the level's share."""
    r = np.random.default_rng(3)
    over = 0
    for _ in range(200):
        good = np.bincount(np.searchsorted(q.GRID, r.beta(1, 12, 2000)), minlength=len(q.GRID) + 1)
        bad = np.bincount(np.searchsorted(q.GRID, r.beta(2, 2, 500)), minlength=len(q.GRID) + 1)
        step = q.certified_cutoff(good, bad, 0.02, 0.05)
        over += step is not None and (1 - q.GRID[step]) ** 12 > 0.02
    assert over <= 0.05 * 200 + 3


def test_strata_without_a_name_count_once(spark):
    """Rows without a stratum are pooled once; an empty name is a stratum like any other."""
    rows = [(i, stratum, False, *[0] * len(q.RULES)) for i, stratum in enumerate([None] * 10 + [""] * 7 + ["en"] * 5)]
    stats = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"{r[0]} int" for r in q.RULES))
    labels = spark.createDataFrame([(i, 1) for i in range(len(rows))], "doc_id long, quality int")
    seen = []
    old, q.certified_cutoff = q.certified_cutoff, lambda good, bad, *_: seen.append(int(good.sum()))
    try:
        q.learn_cutoffs(stats, labels)
    finally:
        q.certified_cutoff = old
    assert sorted(seen) == sorted([22, 7, 5] * len(q.RULES))


def test_rules_reject_junk_and_keep_clean(spark):
    r = random.Random(5)
    clean = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(40))
    junk = lambda: " ".join(f"w{r.randrange(5000)}$$$" for _ in range(40))
    rows = [(i, clean() if i % 4 else junk(), r.choice(["en", "fr", None])) for i in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 12000)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in q.quality_verdicts(docs, labels).where("kept").collect()}
    assert kept == {i for i, _, _ in rows if i % 4}
    assert {x.doc_id for x in q.keep_good(docs.withColumn("stratum", docs.lang), labels).collect()} == kept
    few = q.quality_verdicts(docs, labels.limit(0)).where("kept").count()
    assert few == 12000
    assert q.quality_verdicts(docs.limit(0), labels).collect() == []
