"""Neighbourhood predicates over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.shared import Rounds


def frame_flag(flag: Column, keys: list[str], order: list[str], low: int, high: int) -> Column:
    """Whether flag holds on any row from low to high, relative to the current one; false over an empty frame."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(low, high)
    return F.coalesce(F.max(flag).over(w), F.lit(False))


def ordinal(keys: list[str], order: list[str]) -> Column:
    """0, 1, ... inside the keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def frame_text(text: str, keys: list[str], order: list[str], low: int, high: int, by: str = "\n") -> Column:
    """The texts of the frame's rows, joined."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(low, high)
    return F.array_join(F.collect_list(text).over(w), by)


def first_positions(df: DataFrame, keys: list[str], position: str, flags: dict[str, Column]) -> DataFrame:
    """Per key the least position at which each flag holds; null where it never does."""
    return df.groupBy(*keys).agg(*[F.min(F.when(f, F.col(position))).alias(name) for name, f in flags.items()])


def next_event(df: DataFrame, keys: list[str], order: list[str], kind: str, kinds: list[str], name: str) -> DataFrame:
    """df's rows of the given kinds with the kind of the next such row of the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(F.col(kind).isin(kinds)).withColumn(name, F.lead(kind).over(w))


def within_rows(left: DataFrame, right: DataFrame, keys: list[str], index: str, reach: int) -> DataFrame:
    """Pairs of rows of one key with left index <= right index <= left index + reach.

    The reach is a handful of positions, so each left row is offered at each of them and the join is on equality.
    """
    others = [c for c in left.columns if c not in (*keys, index)]
    offered = left.select(*keys, *others, F.col(index).alias("left_index"), F.explode(F.sequence(F.col(index), F.col(index) + reach)).alias(index))
    return offered.join(right, [*keys, index]).withColumnRenamed(index, "right_index")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row, from 1, in the order of all rows; rows equal in ``order`` are told apart at random.

    Rows are dealt out by ranges of the order and written, so every later job sees the same ranges; each range is numbered
    on its own from the sum of the counts before it. The driver sees a count for each range.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = Rounds(spark, "ranks").save(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    table = spark.createDataFrame(offsets, "_range int, _before long")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(table), "_range").withColumn(name, at + F.col("_before")).drop("_range", "_before")


def bracket_pairs(df: DataFrame, keys: list[str], text: str, pair: str = "()") -> DataFrame:
    """keys, open, close, depth: every bracket of a text with its partner, of any nesting; places from 1.

    A running sum over the brackets gives each its depth (a closing one that closes nothing counts nothing); the n-th that opens a
    depth and the n-th that closes it belong together. Brackets without a partner have no row. keys tell the texts apart.
    """
    pieces = F.split(text, f"(?<=[\\{pair[0]}\\{pair[1]}])", -1)
    marks = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.when(F.endswith(p, F.lit(pair[0])), 1).when(F.endswith(p, F.lit(pair[1])), -1).otherwise(0).alias("step")))
    order = Window.partitionBy(*keys).orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, F.posexplode(marks).alias("i", "m")).select(*keys, "i", F.sum("m.n").over(upto).alias("at"), F.col("m.step").alias("step")).where("step <> 0")
    total = rows.withColumn("total", F.sum("step").over(upto))
    # what falls below the least so far closes nothing
    least = F.least(F.min("total").over(upto), F.lit(0))
    level = total.withColumn("level", F.col("total") - least).withColumn("before", F.coalesce(F.lag("level").over(order), F.lit(0)))
    real = level.where((F.col("step") == 1) | (F.col("before") > 0)).withColumn("depth", F.when(F.col("step") == 1, F.col("level")).otherwise(F.col("before")))
    ranked_ = real.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "depth", "step").orderBy("i")))
    opens = ranked_.where("step = 1").select(*keys, "depth", "nth", F.col("at").alias("open"))
    closes = ranked_.where("step = -1").select(*keys, "depth", "nth", F.col("at").alias("close"))
    return opens.join(closes, [*keys, "depth", "nth"]).select(*keys, "open", "close", "depth")


def first_per_place(df: DataFrame, keys: list[str], text: str, patterns: list[str]) -> DataFrame:
    """keys, place, rank, found: what several patterns find in a text, of matches that begin at one place the first pattern's.

    Places count from 1. Each pattern is scanned once; the lengths of what lies between its matches give their places.
    """
    out = None
    for rank, p in enumerate(patterns):
        found, between = F.regexp_extract_all(text, F.lit(p), 0), F.split(text, p, -1)
        each = df.where(F.size(found) > 0).select(*keys, F.posexplode(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("found")))).alias("i", "m"))
        so_far = F.sum(F.col("m.gap") + F.length("m.found")).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        part = each.select(*keys, (so_far - F.length("m.found") + 1).alias("place"), F.lit(rank).alias("rank"), F.col("m.found").alias("found"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "place").agg(F.min(F.struct("rank", "found")).alias("f")).select(*keys, "place", F.col("f.rank").alias("rank"), F.col("f.found").alias("found"))
