"""Nodes and edges as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resolve(wanted: DataFrame, known: DataFrame, name: str, misses: str = "external:", last: int = 9) -> DataFrame:
    """Each wanted name with the id of its best candidate (least prio, then least id), or an external id where it has none."""
    best = known.groupBy(name).agg(F.min(F.struct("prio", "id")).alias("_b"))
    return wanted.join(best, name, "left").select(name, F.coalesce("_b.id", F.concat(F.lit(misses), name)).alias("id"), F.coalesce("_b.prio", F.lit(last)).alias("prio"))


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with non-blank ends that both are nodes."""
    kept = edges.where("source <> '' and target <> ''")
    for end in ("source", "target"):
        kept = kept.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return kept


def outgoing(edges: DataFrame, source: str, kind: str, flags: dict[str, str]) -> DataFrame:
    """Per source a flag for each kind that is asked for, and the sorted set of kinds."""
    return edges.groupBy(source).agg(*[F.bool_or(F.col(kind) == k).alias(f) for f, k in flags.items()], F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


def color(name: Column, fixed: dict[str, str]) -> Column:
    """A fixed colour by lower-cased name, else six digits of the name's digest."""
    out = F.concat(F.lit("#"), F.left(F.sha2(name, 256), F.lit(6)))
    for k, v in fixed.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out
