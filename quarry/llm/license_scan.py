"""License scan: phrases word for word, and an exact containment join of text blocks with license templates.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A phrase is found wherever its
words stand consecutively. A template is a set of words; a text is cut into blocks of twice the template's words, a new one
every half template, so each run of one and a half times its words lies in a block. A block meets a template if it holds
PERCENT hundredths of its distinct words. The join is exact:

* words of templates are put in order of their frequency over all documents (one counting pass, pre-added in the tasks; a
  row for each template word reaches the driver), rare ones first;
* prefix: of n words, k must be found, so a block that meets the template holds one of its n - k + 1 rarest words; only
  blocks with such a word are looked at, and only words of templates count in them;
* length: such a block has at least k words of templates;
* position: with the first common word at place i of the template and j of the block, no more than the rest of either can be
  common;
* what passes is verified by counting.

Templates are a parameter and the small side: they are sent to the tasks, in blocks of at most TEMPLATE_BYTES of text. Texts are
read whole and never shuffled.

Defined cases: null and empty texts have no words, no labels and a score of 0. Repeated rows give a row each, null ids pass
through, other columns are ignored. Templates without words are refused. A document's score is 1 with a phrase, else the
greatest share of a template's words that one of its blocks holds, if that meets the threshold, else 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontaminate import GAPS
from .scratch import bounded_batches
from .text import Texts, chunks, column_bytes

PERCENT, TEMPLATE_BYTES = 85, 4 << 20

# Phrases with their labels, and short notices of well-known public licenses.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_U = np.uint64


def _hashes(text: str) -> np.ndarray:
    data, offsets = column_bytes(pa.array([text], pa.string()))
    return Texts(data, offsets, GAPS).word_hashes()


def needed(n: int, percent: int) -> int:
    """Of n distinct words, how many a block must hold."""
    return max(1, -(-percent * n // 100))


class Vocabulary:
    """Sorted hashes of the templates' words, with a bitmap of their high bits."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.words = np.unique(np.concatenate([_hashes(t) for _, t in templates]))
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.words >> _U(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are the templates', and their places in the vocabulary."""
        at = np.flatnonzero(self.seen[(hashes >> _U(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
        hit = self.words[place] == hashes[at]
        return at[hit], place[hit]


class Index:
    """Templates with their words as ranks of global frequency, rare ones first."""

    def __init__(self, templates: list[tuple[str, str]], counts: np.ndarray, percent: int):
        self.vocabulary = Vocabulary(templates)
        by = np.lexsort((self.vocabulary.words, counts))
        self.rank = np.empty(len(by), np.int64)
        self.rank[by] = np.arange(len(by))
        self.templates = []
        for label, text in templates:
            words = _hashes(text)
            ranks = np.sort(self.rank[np.searchsorted(self.vocabulary.words, np.unique(words))])
            k = needed(len(ranks), percent)
            place = np.full(len(by), -1, np.int64)
            place[ranks] = np.arange(len(ranks))
            self.templates.append((label, 2 * len(words), max(1, len(words) // 2), k, len(ranks), place))

    def blocks(self, texts: Texts, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each template: its number, and text, first word and common words of the blocks that meet it."""
        at, word = self.vocabulary.find(hashes)
        rank = self.rank[word]
        own = np.searchsorted(texts.first, at, side="right") - 1
        for t, (_, width, step, k, n, place) in enumerate(self.templates):
            spot = place[rank]
            lead = np.flatnonzero((spot >= 0) & (spot <= n - k))
            if not len(lead):
                continue
            # every block that holds one of the rarest words
            offset = at[lead] - texts.first[own[lead]]
            last = offset // step
            reach = np.arange(-(-width // step))
            block = last[:, None] - reach
            inside = (block >= 0) & (block * step + width > offset[:, None])
            pairs = np.unique(np.stack([np.repeat(own[lead], inside.sum(axis=1)), block[inside]]), axis=1)
            begin = texts.first[pairs[0]] + pairs[1] * step
            end = np.minimum(begin + width, texts.first[pairs[0] + 1])
            lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end)
            # distinct words of the vocabulary in each block, in order of frequency
            of = np.repeat(np.arange(len(lo)), hi - lo)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            key = np.unique(of * len(place) + rank[inner])
            of, spots = key // len(place), place[key % len(place)]
            size = np.bincount(of, minlength=len(lo))
            j = np.arange(len(of)) - (np.cumsum(size) - size)[of]
            common = np.flatnonzero(spots >= 0)
            holder, first = np.unique(of[common], return_index=True)
            first = common[first]
            rest = 1 + np.minimum(n - spots[first] - 1, size[holder] - j[first] - 1)
            passes = np.zeros(len(lo), dtype=bool)
            passes[holder] = (size[holder] >= k) & (rest >= k)
            common = common[passes[of[common]]]
            shared = np.bincount(of[common], minlength=len(lo))
            meets = np.flatnonzero(shared >= k)
            if len(meets):
                yield t, pairs[0][meets], pairs[1][meets] * step, shared[meets]


def _texts(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    data, offsets = column_bytes(column)
    for i, j in chunks(offsets):
        yield i, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], GAPS)


def word_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> np.ndarray:
    """How often each word of the templates' vocabulary occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                total += np.bincount(vocabulary.find(texts.word_hashes())[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["word", "n"])

    out = np.zeros(len(sent.value.words), np.int64)
    for word, n in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


def _pieces(templates: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """The templates in blocks of at most TEMPLATE_BYTES, or of one larger template."""
    part, held = [], 0
    for label, text in templates:
        if not len(_hashes(text)):
            raise ValueError(f"template without words: {label}")
        size = len(text.encode())
        if part and held + size > TEMPLATE_BYTES:
            yield part
            part, held = [], 0
        part.append((label, text))
        held += size
    if part:
        yield part


def license_blocks(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """A row for each block of a document that meets a template: doc_id, label, first_word, end_word, containment."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, label string, first_word long, end_word long, containment double"

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for i, texts in _texts(batch.column(1)):
                    for t, own, first, shared in index.blocks(texts, texts.word_hashes()):
                        label, width, _, _, n, _ = index.templates[t]
                        columns = [batch.column(0).take(pa.array(i + own)), pa.array([label] * len(own)), pa.array(first), pa.array(np.minimum(first + width, texts.counts[own])), pa.array(shared / n)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "first_word", "end_word", "containment"])

        return run

    out = None
    for part in _pieces(list(templates)):
        sent = spark.sparkContext.broadcast(Index(part, word_counts(docs, part), percent))
        found = docs.select("doc_id", "text").mapInArrow(search(sent), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _phrases(phrases, texts: Texts, hashes: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Places, among all words, where each phrase begins."""
    room = np.repeat(texts.first[1:], texts.counts) - np.arange(len(hashes))  # words from each to the end of its text
    for phrase, label in phrases:
        words = _hashes(phrase)
        at = np.flatnonzero((hashes == words[0]) & (room >= len(words)))
        for d in range(1, len(words)):
            at = at[hashes[at + d] == words[d]]
        if len(at):
            yield label, at


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The templates must fit one block of TEMPLATE_BYTES; ``license_blocks`` takes any number.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = list(_pieces(list(templates)))
    if len(parts) != 1:
        raise ValueError("give templates, of at most TEMPLATE_BYTES together")
    sent = spark.sparkContext.broadcast(Index(parts[0], word_counts(docs, parts[0]), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            n = batch.num_rows
            words, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            score = np.zeros(n)
            plain: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            for i, texts in _texts(batch.column(1)):
                hashes = texts.word_hashes()
                words[i : i + len(texts)] = texts.counts
                for label, at in _phrases(phrases, texts, hashes):
                    own = np.searchsorted(texts.first, at, side="right") - 1
                    np.add.at(base, i + own, 1)
                    np.minimum.at(first, i + own, at - texts.first[own])
                    np.maximum.at(last, i + own, at - texts.first[own])
                    score[i + own] = 1.0
                    for k in set((i + own).tolist()):
                        plain[k].add(label)
                for t, own, _, shared in index.blocks(texts, hashes):
                    np.maximum.at(score, i + own, shared / index.templates[t][4])
                    for k in set((i + own).tolist()):
                        more[k].add(index.templates[t][0])
            none = base == 0
            columns = [batch.column(0), pa.array(words), pa.array(base), pa.array(first, mask=none), pa.array(last, mask=none)]
            columns += [pa.array([",".join(sorted(x)) for x in plain]), pa.array([",".join(sorted(x | y)) for x, y in zip(plain, more)]), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(c.split()[0] for c in _OUT.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_OUT}")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows from DuckDB, which compares all blocks with all templates."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = lambda s: f"translate({s}, '{upper}', '{upper.lower()}')"
    split = lambda s: rf"regexp_extract_all({low(s)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"({quote(p)}, {quote(label)})" for p, label in PHRASES)
    templates = ", ".join(f"({quote(label)}, {quote(t)})" for label, t in TEMPLATES)
    return f"""
with d as materialized (select row_number() over () as r, doc_id, {split("coalesce(text, '')")} as w from documents),
p as (select string_split(p, ' ') as p, label from (values {phrases}) v(p, label)),
hits as (
  select r, label, unnest([i - 1 for i in range(1, len(w) + 1) if w[i] = p[1] and w[i : i + len(p) - 1] = p]) as i from d, p),
base as (select r, count(*) as n, min(i) as a, max(i) as z, string_agg(distinct label, ',' order by label) as labels, list(distinct label) as each from hits group by r),
t as (select label, {split('t')} as tw from (values {templates}) v(label, t)),
s as (select label, list_distinct(tw) as tw, 2 * len(tw) as width, greatest(1, len(tw) // 2) as step from t),
near as (
  select r, label, max(len(list_intersect(w[i * step + 1 : i * step + width], tw)) / len(tw)::double) as c
  from (select r, w, s.*, unnest(range(0, (len(w) + step - 1) // step)) as i from d, s where len(list_intersect(w, tw)) >= ceil({PERCENT} * len(tw) / 100.0))
  group by r, label having 100 * max(len(list_intersect(w[i * step + 1 : i * step + width], tw))) >= {PERCENT} * any_value(len(tw))),
more as (select r, max(c) as c, list(distinct label) as each from near group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, a::bigint as first_word, z::bigint as last_word,
  coalesce(base.labels, '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.each, []), coalesce(more.each, [])))), ','), '') as labels,
  (case when n > 0 then 1.0 else coalesce(c, 0.0) end)::double as score
from d left join base using (r) left join more using (r)"""
