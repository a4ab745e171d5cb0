"""Balanced label propagation into shards of equal row counts.

Rows start in the shard of their hash. In each round rows count the shards of their neighbours, in turns of those below
and those above them in id so that two don't swap for ever (a partial aggregation: a hub's links never meet in one
task), and move to the one that most of them have, as far as its quota has room: the rows that want into a shard are ranked, by prefix sums over hash buckets, and
those within the quota move. Only moves that put more links inside a shard than they take out are asked for. Quotas
count linked rows; rows without links make way afterwards: each shard keeps its first ``quota`` rows, linked ones first, and
what is over fills the free slots of the others in one order. So counts differ by at most one (the law ``rows``), whatever
the links are.

Links here are those of equal texts: each row of a group links with its least row. A group larger than a quota fills it,
and its other rows stay where their hash put them.

Defined cases: a null text has no bytes (size 16, checksum 0) and is equal to an empty one. Repeated rows are rows of their own with
a place each; null ids too. With fewer rows than shards some shards are empty. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch, hot_join, partitions

SHARDS, ROUNDS, OVERHEAD = 40, 6, 16


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """df with ``out``: each row's rank from 0 among the rows of its keys, without gathering a key in one task.

    Ranks follow hash buckets of ``id``, and ``order`` inside a bucket.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return df.join(before.hint("merge"), [*keys, "_b"]).withColumn(out, F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def by_shard(shard: str, values: list[int]) -> Column:
    """The value of each shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(shard) + 1).cast("long")


def balanced_shards(rows: DataFrame, links: DataFrame, scratch: Scratch, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per id of rows: id, shard, slot. links: pairs (a, b) of ids with b < a, without repeats."""
    spark = rows.sparkSession
    buckets = partitions(spark)
    linked = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().withColumn("linked", F.lit(True))
    start = rows.select("id").join(linked.hint("merge"), "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"))
    state = scratch.save(start, "state-0")
    total = state.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    both = links.select("a", "b"), links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # how many rows ask about each neighbour: the shard of a hub goes to all tasks instead of its links to one
    asking = [scratch.save(side.groupBy("b").agg(F.count("*").alias("n_links")), f"asking-{k}") for k, side in enumerate(both)]
    n_links = links.count()
    still = 0
    for k in range(rounds):
        about = state.select(F.col("id").alias("b"), "shard").join(asking[k % 2].hint("merge"), "b")
        votes = hot_join(both[k % 2], about, ["b"], "n_links", n_links).groupBy("a", "shard").agg(F.count("*").alias("n"))
        first = votes.groupBy("a").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("wanted"), F.max("n").alias("n"))
        own = votes.select("a", "shard", F.col("n").alias("own"))
        asked = state.where("linked").join(first.withColumnRenamed("a", "id").hint("merge"), "id").join(own.withColumnRenamed("a", "id").hint("merge"), ["id", "shard"], "left")
        asked = asked.where("wanted <> shard and n > coalesce(own, 0)").select("id", "shard", "wanted")
        asked = scratch.save(asked, f"asked-{k}")
        held = {r.shard: r.n for r in state.where("linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [max(0, quota[s] - held.get(s, 0)) for s in range(shards)]
        going = ranked(asked, ["wanted"], ["id"], "rank", buckets).where(F.col("rank") < by_shard("wanted", room)).select("id", "wanted")
        new = scratch.save(state.join(going.hint("merge"), "id", "left").select("id", "linked", F.coalesce("wanted", "shard").alias("shard"), F.col("wanted").isNotNull().alias("moved")), f"state-{k + 1}")
        moved = new.where("moved").limit(1).count()
        scratch.drop(f"state-{k}", f"asked-{k}")
        state = new.drop("moved")
        still = 0 if moved else still + 1
        if still == 2:
            break
    # the rank in a shard: linked rows first
    counts = {(r.shard, r.linked): r.n for r in state.groupBy("shard", "linked").agg(F.count("*").alias("n")).collect()}
    place = ranked(state, ["shard", "linked"], ["id"], "rank", buckets)
    place = place.withColumn("rank", F.col("rank") + F.when(F.col("linked"), F.lit(0)).otherwise(by_shard("shard", [counts.get((s, True), 0) for s in range(shards)])))
    held = [counts.get((s, True), 0) + counts.get((s, False), 0) for s in range(shards)]
    over, free = [], []
    for s in range(shards):
        over.append(sum(max(0, held[t] - quota[t]) for t in range(s)))
        free.append(sum(max(0, quota[t] - held[t]) for t in range(s)))
    left = (F.col("rank") >= by_shard("shard", quota))
    # the k-th row that is over takes the k-th free slot
    turn = by_shard("shard", over) + F.col("rank") - by_shard("shard", quota)
    place = place.withColumn("turn", F.when(left, turn))
    target = F.lit(0)
    for s in range(1, shards):
        target = target + (F.col("turn") >= free[s]).cast("int")
    # the last shard whose free slots begin at or before the turn and that has any
    place = place.withColumn("shard", F.when(F.col("turn").isNull(), F.col("shard")).otherwise(target))
    slot = F.when(F.col("turn").isNull(), F.col("rank")).otherwise(F.least(by_shard("shard", held), by_shard("shard", quota)) + F.col("turn") - by_shard("shard", free))
    return place.select("id", "shard", slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the number of rows with its text."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = scratch.save(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    groups = scratch.save(rows.groupBy("key", "text_crc32", "size").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1"), "groups")
    links = scratch.save(hot_join(rows, groups, ["key", "text_crc32", "size"], "copies", rows.count()).where("id > least").select(F.col("id").alias("a"), F.col("least").alias("b")), "links")
    placed = balanced_shards(rows, links, scratch, shards, rounds)
    return rows.join(placed.hint("merge"), "id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
