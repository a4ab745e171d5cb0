import random
import re

from quarry.llm import decontaminate as d

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def tokens(text):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best(item, text):
    """The least edit distance of item to a part of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(rows, items):
    out = {}
    for i, text in rows:
        t = tokens(text)
        for k, item in items:
            m = tokens(item)
            if item is not None and m and (n := best(m, t)) <= len(m) // d.ERROR_EVERY:
                out[i, k] = n
    return out


def case():
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["é", "Ünï"]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([3, 5, 9, 10, 19, 20, 21, 35, 64, 65, 130])]
    items += [(50, None), (51, ""), (52, items[4][1])]
    rows = [(900, None), (901, ""), (902, items[5][1].upper().replace(" ", ",\n"))]
    for i in range(250):
        part = [r.choice(words) for _ in range(r.randrange(0, 80))]
        if i % 2:
            copy = (items[r.randrange(11)][1]).split()
            for _ in range(r.randrange(0, 8)):
                at = r.randrange(len(copy))
                copy[at : at + r.randrange(2)] = [r.choice(words)] * r.randrange(2)
                copy = copy or ["w0"]
            at = r.randrange(len(part) + 1)
            part[at:at] = copy
        rows.append((i, " ".join(part)))
    return rows, items


def test_against_the_full_table(spark):
    rows, items = case()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    got = {}
    for x in d.find_leaks(docs, bench).collect():
        got[x.doc_id, x.item_id] = min(x.distance, got.get((x.doc_id, x.item_id), 99))
        t = tokens(dict(rows)[x.doc_id])[x.first_token : x.end_token]
        assert best(tokens(dict(items)[x.item_id]), t) == x.distance
    assert got.keys() == want.keys() and len(want) > 60
    clean = {x.doc_id for x in d.drop_leaks(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}


def test_blocks_and_empty(spark, monkeypatch):
    rows, items = case()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 900)
    assert len(list(d.blocks(bench))) > 2
    assert sorted(map(tuple, d.find_leaks(docs, bench).collect())) == whole
    assert d.find_leaks(docs, bench.limit(0)).collect() == []
    assert d.find_leaks(docs.limit(0), bench).collect() == []
    assert d.drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_text_ids_short_and_equal_items(spark):
    docs = spark.createDataFrame([(1, "say one two three four five six seven"), (2, "yes"), (3, "no")], "doc_id long, text string")
    items = [("a", "one two three four five six"), ("b", "One, two three; four five six!"), (None, "YES"), ("d", "..."), ("e", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((x.doc_id, x.item_id, x.first_token, x.distance) for x in d.find_leaks(docs, bench).collect()), key=str)
    assert got == [(1, "a", 1, 0), (1, "b", 1, 0), (2, None, 0, 0)]
    assert [x.doc_id for x in d.drop_leaks(docs, bench).collect()] == [3]
