"""First-wins, caps, digests and set differences by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """Per key the values of its first row; a partial aggregation, so hot keys stay cheap."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """At most n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def set_digest(name: Column, content: Column) -> Column:
    """sha256 over the sorted (name, NUL, digest of the content) of a group: independent of the order of its rows."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat(name, F.lit("\0"), F.sha2(content, 256)))), ""), 256)


def diff(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """added, removed and unchanged keys from scan a to scan b; rows of one key collapse, the last one wins."""
    last = lambda df, name: df.groupBy(*keys).agg(F.max(order).alias(name))
    both = last(a, "in_a").join(last(b, "in_b"), keys, "full_outer")
    return both.select(*keys, F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("unchanged").alias("change"), "in_a", "in_b")


def clean_limit(n: int) -> int:
    return max(1, min(int(n), 500))


def newest(df: DataFrame, stamp: str, ident: str, n: int) -> DataFrame:
    """The newest rows, later ids first among equal stamps; n is clamped to 1..500."""
    return df.orderBy(F.desc(stamp), F.desc(ident)).limit(clean_limit(n))


def contains_join(texts: DataFrame, text: str, parts: DataFrame, part: str, ids: list[str], part_ids: list[str], words: int = 5) -> DataFrame:
    """Rows of texts with the rows of parts that occur in them as substrings.

    A part's inner words (all but the first and last, which may go on in the text; ``words`` at most) must be words of the
    text, so the join is on a hash of them, over ids and hashes alone; texts come back for the pairs found, each once. There
    are a few numbers of inner words, and texts are cut for those that occur. Only parts of one or two words are tested
    against every text. Null ids are ids like others; null texts and parts hold and are nothing.
    """
    split = lambda c: F.split(c, "[ \n]", -1)
    inner = F.least(F.size("_w") - 2, F.lit(words))
    parts = parts.where(F.col(part).isNotNull()).withColumn("_w", split(F.col(part))).withColumn("_m", F.greatest(inner, F.lit(0)))
    texts = texts.where(F.col(text).isNotNull())
    same = lambda a, b, names: F.expr(" and ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in names))
    pairs = None
    for m in sorted(r["_m"] for r in parts.select("_m").distinct().where("_m > 0").collect()):
        wanted = parts.where(F.col("_m") == m).select(*part_ids, F.xxhash64(F.slice("_w", 2, m)).alias("_k"))
        windows = texts.withColumn("_t", split(F.col(text)))
        keys = _word_windows(m)
        found = windows.select(*ids, F.explode(keys).alias("_k")).join(wanted, "_k").select(*ids, *part_ids)
        pairs = found if pairs is None else pairs.unionByName(found)
    names = [c for c in parts.columns if c not in ("_w", "_m")]
    short = parts.where("_m = 0").select(*names)
    out = texts.join(short, F.contains(text, F.col(part)))
    if pairs is None:
        return out
    pairs = pairs.distinct().alias("p")
    met = pairs.join(parts.select(*names).alias("q"), same("p", "q", part_ids)).select(*[F.col(f"p.`{c}`") for c in ids], *[F.col(f"q.`{c}`") for c in names]).alias("r")
    whole = met.join(texts.alias("t"), same("r", "t", ids)).select(*[F.col(f"t.`{c}`") for c in texts.columns], *[F.col(f"r.`{c}`") for c in names])
    return whole.where(F.contains(text, F.col(part))).unionByName(out)


def _word_windows(m: int) -> Column:
    """Hashes of all runs of m words of _t."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_t") - (m - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_t", i, m))))
