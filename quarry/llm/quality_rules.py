"""Quality rules whose cutoffs come with an exact bound on false rejections.

Each rule rejects a text when a ratio exceeds a cutoff. Cutoffs come from labelled documents: for each stratum (a
language) and rule, the grid is tried from the loosest cutoff on; a cutoff is *certified* while an exact binomial test
on the stratum's good documents says, at level delta / (rules * strata), that it rejects no more than
max_false_rejection / rules of them. The first failure ends the sequence, so each sequence costs its level once
(fixed-sequence testing) and all of them together hold at delta (Bonferroni); the union bound over the rules then limits
what is rejected of a stratum's good documents to max_false_rejection. Among certified cutoffs the one with the best
balance of bad against good documents is taken, the loosest in a tie. A stratum with too few labelled documents to
certify a rule takes the cutoff of the pooled stratum, which is certified for all documents together.

Only counts by stratum, rule and grid step reach the driver: 1 / LEAST_SHARE strata by rules by steps.

Defined cases: null or empty texts have no words and fail the base rules. Texts shorter than a window have no repeats.
A null or unseen stratum takes the pooled cutoffs. Documents without labels, labels without documents and null
qualities do not count; a document with several labels is good if all of them are. Without labels, or with too few, no
cutoff is certified and only the base rules reject. Repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch, sieve
from .text import _CASED, SPACE, Texts, _powers, mix, text_chunks

_U = np.uint64
BASE_MIN_WORDS, BASE_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: All of a stratum's good documents that the rules may reject, and the chance that the bound fails.
MAX_FALSE_REJECTION, DELTA = 0.02, 0.05
#: Strata get their own cutoffs if they hold at least this share of the labelled documents; so there are at most 1000.
LEAST_SHARE = 0.001
#: The weight of a good document that is rejected against that of a bad one.
GOOD_WEIGHT = 10
#: Rules: name, what it divides, by what.
RULES = (("symbol_ratio", "n_symbols", "n_words"), ("capital_ratio", "n_capitals", "n_letters"), ("shout_ratio", "n_bangs", "n_words"), ("dup_line_ratio", "n_dup_lines", "n_lines"), ("repeat_ratio", "n_repeat_words", "n_words"), ("stutter_ratio", "n_stutters", "n_words"))
#: Cutoffs that are tried, for every rule: 0.02 to 1 in steps of 0.02.
GRID = np.arange(1, 51) / 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_bangs", "n_stutters")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[0x41:0x5B] = True
_LETTER = _CAPITAL.copy()
_LETTER[0x61:0x7B] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def text_stats(texts: Texts) -> dict[str, np.ndarray]:
    """The counts named in STATS for each text."""
    data, offsets, n = texts.data, texts.offsets, len(texts)
    word = ~SPACE[data]
    out = {"n_words": texts.counts}
    out["word_chars"] = _per_text(word & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_text(_SYMBOL[data], offsets)
    out["n_capitals"] = _per_text(_CAPITAL[data], offsets)
    out["n_letters"] = _per_text(_LETTER[data], offsets)
    out["n_bangs"] = _per_text(data == 0x21, offsets)

    # lines: cut at each \n and at each end of a text
    feeds = np.flatnonzero(data == 0x0A)
    ends = np.concatenate((feeds, offsets[1:]))
    of = np.concatenate((np.searchsorted(offsets, feeds, side="right") - 1, np.arange(n)))
    order = np.lexsort((ends, of))
    ends, of = ends[order], of[order]
    begins = np.concatenate(([0], ends[:-1] + 1))
    first = np.concatenate(([True], of[1:] != of[:-1]))
    begins[first] = offsets[of[first]]
    inside = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, begins)
    begins, ends, of = begins[inside], ends[inside], of[inside]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([_U(0)], np.cumsum(_CASED[data] * up[: len(data)], dtype=_U)))
        keys = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(_U))
        keys = mix(keys + mix(of))
    _, seen = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[seen], minlength=n)

    hashes = texts.word_hashes(lower=False)
    owner = np.repeat(np.arange(n), texts.counts)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_stutters"] = np.bincount(owner[same], minlength=n)
    grams, bounds = texts.windows(hashes, WINDOW)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(grams):
        counts = np.diff(bounds)
        text_of = np.repeat(np.arange(n), counts)
        at = np.arange(len(grams)) + np.repeat(texts.first[:-1] - bounds[:-1], counts)
        with np.errstate(over="ignore"):
            keys = mix(grams + mix(text_of))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        twin = np.zeros(len(ranked), dtype=bool)
        twin[1:] = ranked[1:] == ranked[:-1]
        twin[:-1] |= twin[1:].copy()
        found = at[order[twin]]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + WINDOW, -1)
    repeated = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(owner[repeated], minlength=n)
    return out


def _stats(column: pa.Array) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(column), dtype=np.int64) for k in STATS}
    for i, j, texts in text_chunks(column):
        for k, v in text_stats(texts).items():
            out[k][i:j] = v
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < BASE_MIN_WORDS) | (100 * stats["n_repeat_words"] > BASE_REPEAT_PERCENT * stats["n_words"])


def steps(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each rule, how many cutoffs of the grid each text exceeds."""
    return {name: np.searchsorted(GRID, stats[a] / np.maximum(stats[b], 1), side="left") for name, a, b in RULES}


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials with chance p: the incomplete beta function I(1 - p; n - k, k + 1), in steps that don't grow with k."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges on one side only
    if swap:
        a, b, x = b, a, p
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 1_000_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d or tiny), 1 + t / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value = front * total / a
    return min(1.0, max(0.0, 1 - value if swap else value))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """The step of the cutoff taken, from the good and bad documents by steps exceeded (0 to len(GRID)); None: no cutoff."""
    n, m = int(good.sum()), int(bad.sum())
    best, best_gain = None, 0.0
    for i in range(len(GRID) - 1, -1, -1):
        lost, caught = int(good[i + 1 :].sum()), int(bad[i + 1 :].sum())
        if n == 0 or lost > n * risk or binomial_below(lost, n, risk) > level:
            break
        gain = caught / max(m, 1) - GOOD_WEIGHT * lost / n
        if gain > best_gain:
            best, best_gain = i, gain
    return best


#: The stratum of all documents together; no language is called so.
POOLED = None


def learn_cutoffs(stats: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule, from rows of stats (doc_id, stratum, base_failed, a step for each rule) and labels (doc_id, quality)."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = stats.where("not base_failed").join(graded, "doc_id").select("stratum", "good", *[r[0] for r in RULES])
    # a row is counted for all documents and, if it has one, for its stratum; once for each rule
    tall = rows.select("good", F.explode(F.array(F.lit(True), F.lit(False))).alias("pooled"), "stratum", *[r[0] for r in RULES]).where("pooled or stratum is not null")
    tall = tall.select("pooled", F.when(~F.col("pooled"), F.col("stratum")).alias("stratum"), "good", F.inline(F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.col(r[0]).alias("step")) for r in RULES])))
    counts = tall.groupBy("pooled", "stratum", "rule", "good", "step").agg(F.count("*").alias("n"))
    share = counts.where(F.col("rule") == RULES[0][0]).groupBy("pooled", "stratum").agg(F.sum("n").alias("n"))
    total = share.where("pooled").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = share.where(F.col("n") >= max(1, total * LEAST_SHARE)).select(F.col("pooled").alias("all"), F.col("stratum").alias("own"))
    counts = counts.join(F.broadcast(large), (F.col("pooled") == F.col("all")) & F.col("stratum").eqNullSafe(F.col("own")))
    found: dict[tuple[str | None, str], dict[bool, np.ndarray]] = {}
    for r in counts.collect():
        found.setdefault((r.stratum, r.rule), {True: np.zeros(len(GRID) + 1, int), False: np.zeros(len(GRID) + 1, int)})[r.good][r.step] += r.n
    strata = {k[0] for k in found}
    out: dict[str | None, dict[str, float]] = {}
    for (stratum, rule), n in found.items():
        step = certified_cutoff(n[True], n[False], max_false_rejection / len(RULES), delta / (len(RULES) * len(strata)))
        if step is not None:
            out.setdefault(stratum, {})[rule] = float(GRID[step])
    return out


def verdict(stats: dict[str, np.ndarray], strata: list, cutoffs: dict[str | None, dict[str, float]]) -> np.ndarray:
    """True where neither a base rule nor a certified cutoff rejects."""
    ok = ~base_failed(stats)
    pooled = cutoffs.get(POOLED, {})
    names = list(dict.fromkeys(strata))
    place = {s: k for k, s in enumerate(names)}
    which = np.array([place[s] for s in strata], dtype=int)
    for name, a, b in RULES:
        limit = np.array([cutoffs.get(s, {}).get(name, pooled.get(name, inf)) for s in names], dtype=float)
        if len(limit):
            ok &= stats[a] / np.maximum(stats[b], 1) <= limit[which]
    return ok


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = _stats(batch.column(1))
        rules = steps(stats)
        columns = [batch.column(0), batch.column(2), *(pa.array(stats[k]) for k in STATS), pa.array(base_failed(stats)), *(pa.array(rules[r[0]].astype(np.int32)) for r in RULES)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "stratum", *STATS, "base_failed", *(r[0] for r in RULES)])


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row of docs: doc_id, stratum, the counts, base_failed and the steps that each rule's ratio exceeds."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, stratum string, {', '.join(f'{k} long' for k in STATS)}, base_failed boolean, {', '.join(f'{r[0]} int' for r in RULES)}"
    return docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum")).mapInArrow(_measure, schema)


def _judge(cutoffs: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in STATS}
            kept = verdict(cols, batch.column("stratum").to_pylist(), cutoffs)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", *STATS, "base_failed")] + [pa.array(kept)], ["doc_id", *STATS, "base_failed", "kept"])

    return run


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    stats = scratch.save(measure(docs, stratum), "stats")
    cutoffs = learn_cutoffs(stats, labels, max_false_rejection, delta)
    kind = dict(docs.dtypes)["doc_id"]
    return stats.mapInArrow(_judge(cutoffs), f"doc_id {kind}, {', '.join(f'{k} long' for k in STATS)}, base_failed boolean, kept boolean")


def _sieve(cutoffs: dict, text_at: int, stratum_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stratum = batch.column(stratum_at).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array(verdict(_stats(batch.column(text_at)), stratum, cutoffs)))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, unchanged; texts are read twice and never shuffled."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    stats = scratch.save(measure(docs, stratum).select("doc_id", "stratum", "base_failed", *[r[0] for r in RULES]), "stats")
    cutoffs = learn_cutoffs(stats, labels, max_false_rejection, delta)
    scratch.drop("stats")
    return sieve(docs, _sieve(cutoffs, docs.columns.index("text"), docs.columns.index(stratum)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
