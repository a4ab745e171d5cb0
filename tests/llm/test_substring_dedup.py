import random

import numpy as np
import pyarrow as pa

from quarry.llm import substring_dedup as d
from quarry.llm.scratch import byte_size
from quarry.llm.text import text_chunks

from .test_ngram_join import WORD

SCHEMA = "doc_id long, text string"


def corpus(edits=(0, 0, 0, 1)):
    """Texts of which every other one holds a passage inside its lines, word for word or edited."""
    r = random.Random(8)
    line = lambda n: [r.choice([f"w{i}" for i in range(300)] + ["é", "Ü"]) for _ in range(n)]
    passages = [line(n) for n in (47, 55, 80, 120)]
    rows, planted = [], []
    for i in range(200):
        words = line(r.randrange(20, 200))
        if i % 2:
            p = list(passages[i // 2 % 4])
            k = r.choice(edits)
            for _ in range(k):
                p[r.randrange(len(p))] = "edit"
            at = r.randrange(len(words) + 1)
            words[at:at] = p
            if not k:
                planted.append((i, i // 2 % 4))
        rows.append((i, "".join(w + r.choice([" ", " ", " ", "\n", "\t"]) for w in words)))
    return rows, planted


def brute(rows, alike=False):
    """Paragraphs by the rule of the module, each text alone and word by word, and their classes from all pairs, or those that begin alike."""
    units = []
    for doc, text in rows:
        spans = [m.span() for m in WORD.finditer(text or "")]
        m = len(spans) - d.WORDS + 1
        if m < 1:
            continue
        (_, _, texts), = text_chunks(pa.array([text]), 1 << 30)
        order = d.mix(texts.windows(texts.word_hashes(), 5)[0])[:m].tolist()
        span = min(d.SPAN, m)
        begins = {min(range(i, i + span), key=lambda k: (order[k], k)) for i in range(m - span + 1)}
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        for b in begins:
            w = words[b : b + d.WORDS]
            units.append((doc, spans[b][0], spans[b + d.WORDS - 1][1], w[:5], frozenset(tuple(w[i : i + 5]) for i in range(d.GRAMS))))
    up = list(range(len(units)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(units):
        for j, y in enumerate(units[:i]):
            k = len(x[4] & y[4]) if x[3] == y[3] or not alike else 0
            if 100 * k >= 80 * (len(x[4]) + len(y[4]) - k):
                up[find(i)] = find(j)
    classes = {}
    for i, x in enumerate(units):
        classes.setdefault(find(i), set()).add(x[:3])
    return sorted(sorted(x) for x in classes.values() if len(x) > 1)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, 3, "b") for i, t in rows], SCHEMA + ", n int, start string").repartition(parts)
    got = d.repeated_paragraphs(docs).collect()
    classes = {}
    for x in got:
        classes.setdefault(x.class_id, set()).add((x.doc_id, x.start, x.end))
    return got, sorted(sorted(x) for x in classes.values())


def joined(classes, rows):
    """No link is made up; of those between paragraphs that begin alike few are lost, since bands are chances."""
    home = {x: k for k, c in enumerate(brute(rows)) for x in c}
    assert all(len({home[x] for x in c}) == 1 for c in classes)
    mine = {x: k for k, c in enumerate(classes) for x in c}
    want = brute(rows, alike=True)
    lost = sum(len({mine.get(x, x) for x in c}) - 1 for c in want)
    assert lost <= 0.02 * sum(len(c) - 1 for c in want)


def test_against_all_pairs(spark):
    rows, planted = corpus()
    rows += [(900, None), (901, ""), (902, rows[1][1] + "\n" + rows[1][1].upper()), (903, "a " * 100)]
    got, classes = found(spark, rows)
    joined(classes, rows)
    assert len(classes) > 20
    texts = dict(rows)
    assert all(len(WORD.findall(texts[x.doc_id][x.start : x.end])) == x.n_words for x in got)
    for x in got:
        own = next(c for c in classes if (x.doc_id, x.start, x.end) in c)
        assert (x.kept_doc_id, x.kept_start, x.copies) == (*min(own)[:2], len(own))
        assert not x.removed or (x.doc_id, x.start) != (x.kept_doc_id, x.kept_start)
    keepers = {(x.kept_doc_id, x.kept_start) for x in got}
    spans = {(x.doc_id, x.start): x.end for x in got}
    for x in got:
        near = any(d == x.doc_id and s < x.end and x.start < spans[d, s] for d, s in keepers)
        assert x.removed == (not near)
    # every passage of 47 words or more that repeats word for word is found inside its line
    assert {i for i, _ in planted} <= {x.doc_id for x in got} and len(planted) > 60


def test_near_copies_of_a_group(spark):
    """A large group around one text: what differs at an end only joins its class."""
    r = random.Random(2)
    base = [f"w{r.randrange(500)}" for _ in range(d.WORDS)]
    rows = []
    for i in range(60):
        w = list(base)
        w[r.choice([-1, -2, 13])] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(5)]
    joined(found(spark, rows, 5)[1], rows)


def test_paragraphs_do_not_depend_on_what_stands_around():
    r = random.Random(5)
    line = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    for n in (47, 52, 90):
        p = line(n)
        texts = [" ".join(line(r.randrange(80)) + p + line(r.randrange(80))) for _ in range(30)]
        sets = [set(d.Paragraphs(t).keys.tolist()) for x in texts for _, _, t in text_chunks(pa.array([x]))]
        assert set.intersection(*sets)
        alone = d.Paragraphs(next(t for _, _, t in text_chunks(pa.array(texts))))
        assert set(alone.keys[alone.of == 3].tolist()) == sets[3]


def shared(words, edits, trials=150):
    """How often two texts with a passage of so many words, in one of them with edits, share a whole paragraph."""
    r = random.Random(words * 10 + edits)
    line = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    hits = 0
    for _ in range(trials):
        p = line(words)
        q = list(p)
        for k in r.sample(range(words), edits):
            q[k] = f"edit{r.randrange(10**6)}"
        texts = [" ".join(line(60) + x + line(60)) for x in (p, q)]
        a, b = (set(d.Paragraphs(t).keys.tolist()) for x in texts for _, _, t in text_chunks(pa.array([x])))
        hits += bool(a & b)
    return hits / trials


def test_recall_of_short_and_edited_passages():
    whole = d.WORDS + d.SPAN - 1
    assert whole == 34 and shared(whole, 0) == shared(60, 0) == 1 and shared(30, 0) > 0.85
    assert shared(47, 1) > 0.83 and shared(60, 1) > 0.95 and shared(60, 2) > 0.83 and shared(100, 4) > 0.95


def test_filter(spark):
    keys = spark.range(40_000).selectExpr("xxhash64(id) as s")
    held = d.key_filter(keys)
    assert held[0] == 20 and d._passes(held, np.array([x.s for x in keys.collect()])).all()
    assert d._passes(held, np.arange(40_000)).mean() < 0.02


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text + "\n"), (7, None), (8, "short")]
    got = d.repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2 and {x.kept_doc_id for x in got} == {None}
    got = d.repeated_paragraphs(spark.createDataFrame(rows + [(9, text.upper())], SCHEMA)).collect()
    assert sorted((x.doc_id or 0, x.removed) for x in got) == [(0, True), (0, True), (9, False)]


def windows(text, size=8):
    w = WORD.findall(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_applied_removals_lose_nothing(spark):
    """Passages and whole texts that repeat word for word, in other texts and their own, and text that repeats itself."""
    r = random.Random(11)
    line = lambda n: [f"w{r.randrange(2000)}" for _ in range(n)]
    passages = [line(n) for n in (40, 60, 90)]
    rows = []
    for i in range(60):
        w = line(r.randrange(10, 80))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        if i % 7 == 0:
            w += (line(r.randrange(1, 40)) * 9)[:200]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    got, _ = found(spark, rows)
    gone = {}
    for x in got:
        if x.removed:
            gone.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    rest = set()
    for i, t in rows:
        rest |= windows("".join(" | " if k in gone.get(i, ()) else c for k, c in enumerate(t)))
    texts, ends = dict(rows), {(x.doc_id, x.start): x.end for x in got}
    # a copy that differs from its keeper may hold words of its own; equal ones must all be there once
    part = lambda i, a: WORD.findall(texts[i][a : ends[i, a]])
    equal = [g for g in got if g.removed and part(g.doc_id, g.start) == part(g.kept_doc_id, g.kept_start)]
    lost = {x for g in equal for x in windows(texts[g.doc_id][g.start : g.end])} - rest
    assert not lost and len(equal) > 300


def test_edges_of_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text + "\n"), (7, None), (8, "short")]
    got = d.repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [x.removed for x in got] == [False, False]
    assert d.repeated_paragraphs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_byte_sizes():
    assert [byte_size(x) for x in ("8m", "64KB", "1048576", "1g", "12b", "2MiB")] == [8 << 20, 64 << 10, 1 << 20, 1 << 30, 12, 2 << 20]


def near(x, y):
    k = len(x & y)
    return 100 * k >= 80 * (len(x) + len(y) - k)


def test_every_near_pair_shares_a_key_and_a_rest():
    """Texts of one paragraph whose ends differ, and such as repeat themselves, by all pairs."""
    r = random.Random(3)
    texts, sets = [], []
    for _ in range(150):
        base = [f"w{r.randrange(10**6)}" for _ in range(d.WORDS + 1)] if r.random() < 0.4 else [r.choice("ab") for _ in range(r.randrange(3, 14))] + [r.choice("abcdef") for _ in range(18)]
        for k in range(4):
            w = base[k % 2 :][: d.WORDS]
            w[(0, -1)[k // 2]] = r.choice(["a", "b", f"x{r.randrange(10**6)}"])
            texts.append(" ".join(w))
            sets.append({tuple(w[i : i + 5]) for i in range(d.GRAMS)})
    (_, _, t), = text_chunks(pa.array(texts), 1 << 30)
    p = d.Paragraphs(t)
    assert p.of.tolist() == list(range(len(texts)))
    keys, owner = p.bands()
    mine = [set(keys[owner == i].tolist()) for i in range(len(texts))]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and near(sets[i], sets[j])]
    assert {abs(len(sets[i]) - len(sets[j])) for i, j in pairs} >= {0, 1, 2} and len(pairs) > 300
    assert all(mine[i] & mine[j] for i, j in pairs)
    assert all(mine[i] & mine[j] for i in range(len(texts)) for j in range(i) if sets[i] == sets[j])


def test_no_link_is_lost(spark):
    """First or last words that differ, passages cut a word apart and texts that repeat themselves: classes as from all pairs."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(d.WORDS + 1)] if i % 3 else [r.choice("ab") for _ in range(r.randrange(3, 14))] + [r.choice("abcdef") for _ in range(18)]
        for k in range(4):
            w = base[k % 2 :][: d.WORDS]
            w[(0, -1)[k // 2]] = r.choice(["a", f"x{r.randrange(10**6)}"])
            rows.append((i * 10 + k, " ".join(w)))
    assert found(spark, rows)[1] == brute(rows)


def test_overlapping_paragraphs_of_one_text_are_no_repeats(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(400))) for i in range(20)]
    assert len(brute(rows)) > 10 and found(spark, rows)[0] == []
