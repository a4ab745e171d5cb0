import zlib

import numpy as np

import corpus_pipeline as p
from quarry.llm.packing import Encoder, default_tokenizer
from quarry.llm.secret_scan import MASK

from . import test_decontaminate, test_ngram_join, test_quality_rules, test_secret_scan

D = "/root/testdata/sf0.001"


def masked(text):
    out, at = "", 0
    for a, _, b, _ in test_secret_scan.base(text):
        if a >= at:
            out += text[at:a] + MASK
        at = max(at, b)
    return out + text[at:]


def test_against_brute_force(spark):
    """With this few labels no cutoff can be certified, so the base rules alone decide."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    stats = {i: test_quality_rules.brute(t) for i, t in rows.items()}
    kept = [(i, rows[i]) for i, x in stats.items() if x[0] >= 20 and 100 * x[4] <= 30 * x[0]]
    kept = [(i, rows[i]) for i, _, c in test_ngram_join.brute(kept) if i == c]
    leaks = {i for i, _ in test_decontaminate.brute(kept, items)}
    library = Encoder(default_tokenizer()).library
    want = []
    for i, t in kept:
        if i not in leaks:
            ids = np.array([*library.encode(masked(t), add_special_tokens=False).ids, 0], dtype="<u4")
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
            want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = p.run(spark, D).collect()
    assert sorted(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == sorted(want)


def test_stages_take_odd_rows(spark):
    """Nulls, empty and repeated rows and clashing columns go through every stage."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, None, None, None, 1), (1, text, "en", "s", 9, 1), (1, text, "en", "s", 9, 1), (2, text + " x", None, "s", 9, 1), (3, None, "en", "s", 0, 1), (4, "", "en", "s", 0, 1), (5, "password=hunter22 " + text[::-1], "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `n.s` long")
    for df in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            new = stage(spark, df, D)
            if stage is not p.packing:
                assert new.schema.simpleString() == docs.schema.simpleString(), name
            df = spark.createDataFrame(new.collect(), new.schema)
        ids = sorted({r.doc_id for r in df.collect()}, key=str)
        assert ids in ([1, 5], [])


def test_texts_of_one_id_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (5, b, 2), (5, b.upper(), 0), (None, c, 1), (None, c, 1), (None, b, 1), (7, None, 1), (7, None, 1), (8, " \t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` int").repartition(3)
    got = [tuple(r) for r in p.near_duplicates(spark, docs, D).collect()]
    assert sorted(((i, (t or "")[:1].lower()) for i, t, _ in got), key=str) == sorted([(3, "a"), (5, "b"), (None, "c"), (7, ""), (7, ""), (8, " ")], key=str)
    assert all(sorted(map(str, got)) == sorted(str(tuple(r)) for r in p.near_duplicates(spark, docs.repartition(k), D).collect()) for k in (1, 4))
