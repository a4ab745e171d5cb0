import random
import re

import pytest

from quarry.llm import license_scan
from quarry.llm.license_scan import PHRASES, TEMPLATES, license_blocks, needed, scan_licenses

SCHEMA = "doc_id long, text string, n_words int, labels string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def meeting(text, templates, percent):
    """(label, first word, past the last word, share) of every block that meets a template."""
    w = words(text)
    for label, t in templates:
        tw = words(t)
        own = set(tw)
        width, step = 2 * len(tw), max(1, len(tw) // 2)
        for first in range(0, len(w), step):
            n = len(own & set(w[first : first + width]))
            if n >= needed(len(own), percent):
                yield label, first, min(first + width, len(w)), n / len(own)


def plain(rows, templates=TEMPLATES, percent=85):
    out = []
    for doc_id, text in rows:
        w = words(text)
        places = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        met = list(meeting(text, templates, percent))
        base = {label for _, label in places}
        score = 1.0 if places else max((m[3] for m in met), default=0.0)
        at = [i for i, _ in places]
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m[0] for m in met})), score))
    return sorted(out, key=str)


def random_texts(seed, n):
    r = random.Random(seed)
    filler = "the of and to is under this work software any License licensed copyright CC BY by é ñandú 4 0 Public General rights reserved all".split()
    rows = []
    for i in range(n):
        line = []
        for _ in range(r.randrange(0, 6)):
            line += [r.choice(filler) for _ in range(r.randrange(0, 30))]
            if r.random() < 0.5:
                t = r.choice(TEMPLATES)[1].split()
                for _ in range(r.randrange(0, 3)):  # edits: the share falls
                    t[r.randrange(len(t))] = r.choice(filler)
                line += t
        rows.append((i, r.choice([" ", "\n", "-", "\x00"]).join(line)))
    long = " ".join(r.choice(filler + TEMPLATES[3][1].split()) for _ in range(30_000))
    return rows + [(None, "All Rights Reserved"), (n, None), (n, ""), (n + 1, "..."), (3, rows[3][1]), (n + 2, long), (n + 3, "cc by"), (n + 4, "cc by cc by cc"), (n + 5, "cc")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_comparison_of_all_blocks(spark, seed):
    rows = random_texts(seed, 120)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in scan_licenses(df).collect()), key=str)
    assert got == plain(rows)
    assert any(r[7] < 1 for r in got if r[6]) and any(r[6] and not r[5] for r in got)


@pytest.mark.parametrize("percent, size", [(60, 1 << 20), (85, 200), (100, 1 << 20)])
def test_blocks_at_other_thresholds_and_in_blocks_of_templates(spark, percent, size, monkeypatch):
    monkeypatch.setattr(license_scan, "TEMPLATE_BYTES", size)
    rows = random_texts(4, 60)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in license_blocks(df, percent=percent).collect()), key=str)
    assert got == sorted(((i, *m) for i, t in rows for m in meeting(t, TEMPLATES, percent)), key=str) and got


def test_no_documents_and_templates_without_words(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scan_licenses(df).collect() == [] and license_blocks(df).collect() == []
    with pytest.raises(ValueError):
        license_blocks(df, [("none", "...")])
