"""URL filter by a sort-merge range join over reversed-host keys.

A host's key is its labels from the last to the first, each ended by a NUL, so that a rule's host and all of its
subdomains are one interval of keys and intervals nest or are apart. A sweep over sorted keys keeps the stack of the
rule hosts whose intervals are open; each entry finds its longest path rule that the url's path starts with. Of all
rules that fit, the longest (host and path together, then host) wins; equal rules that disagree block.

Rules of up to BROADCAST_BYTES are sent to the tasks, which sort the keys of each batch and sweep: no shuffle, and one
hot host is as cheap as any. Beyond that both sides are dealt by intervals of keys that hold equal shares of rules: a
rule goes to every interval that it overlaps, urls go to their own, and intervals with many urls are salted.

Defined cases: a null url, or one without ``://``, has empty host and path, and no rule fits it; such a url, and any
other without a rule, gets the default verdict. Empty tables and empty rules are fine; repeated rows give a row each;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch, partitions

#: host, path, verdict
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
BROADCAST_BYTES = 8 << 20
#: Urls that one interval holds before it is salted.
INTERVAL_ROWS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_key(host: str) -> str:
    return "".join(f"{x}\0" for x in reversed(host.split(".")))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the host's key."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    df = pages.select("page_id", host.alias("host"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))
    return df.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "\0"), F.lit("\0")))


class Sweep:
    """Rules by host key; ``judge`` sweeps over keys and paths."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        hosts: dict[str, tuple[str, dict[str, str]]] = {}
        for host, path, verdict in rules:
            paths = hosts.setdefault(host_key(host), (host, {}))[1]
            paths[path] = max(paths.get(path, ""), verdict)  # block after allow
        self.hosts = [(key, host, paths, sorted({len(p) for p in paths}, reverse=True)) for key, (host, paths) in sorted(hosts.items())]

    def judge(self, keys: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        rule: list[str | None] = [None] * len(keys)
        verdict: list[str | None] = [None] * len(keys)
        stack: list = []
        i, n = 0, len(self.hosts)
        for at in sorted(range(len(keys)), key=keys.__getitem__):
            key, path = keys[at], paths[at]
            while i < n and self.hosts[i][0] <= key:
                while stack and not self.hosts[i][0].startswith(stack[-1][0]):
                    stack.pop()
                stack.append(self.hosts[i])
                i += 1
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            best = (-1, -1)
            for _, host, own, sizes in stack:
                for size in sizes:
                    if size <= len(path) and path[:size] in own:
                        if (rank := (len(host) + size, len(host))) > best:
                            best, rule[at], verdict[at] = rank, host + path[:size], own[path[:size]]
                        break
        return rule, verdict


_NAMES = ["page_id", "host", "path", "rule", "verdict"]


def _swept(sweep: Sweep, table, default: str):
    rule, verdict = sweep.judge(table.column("key").to_pylist(), table.column("path").to_pylist())
    return [table.column(k) for k in _NAMES[:3]] + [pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())]


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict. rules: host, path, verdict, none null."""
    spark = pages.sparkSession
    urls = parsed(pages)
    schema = f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string"
    rules = rules.select("host", "path", "verdict")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast([tuple(r) for r in rules.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sweep = Sweep(held.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(_swept(sweep, batch, default), _NAMES)

        return urls.mapInArrow(run, schema)

    # intervals of keys with equal shares of the rules
    scratch = Scratch(spark, "url-filter")
    keyed = rules.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "\0"), F.lit("\0")))
    parts = max(partitions(spark), -(-size // BROADCAST_BYTES))
    dealt = scratch.save(keyed.repartitionByRange(parts, "key").withColumn("p", F.spark_partition_id()), "rules")
    bounds = sorted(r.low for r in dealt.groupBy("p").agg(F.min("key").alias("low")).collect())[1:]  # one for each interval

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array([bisect_right(bounds, k) for k in batch.column("key").to_pylist()], pa.int32()))

    def overlapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, part = [], []
            for i, k in enumerate(batch.column("key").to_pylist()):
                for p in range(bisect_right(bounds, k), bisect_right(bounds, k + "\U0010ffff") + 1):
                    rows.append(i)
                    part.append(p)
            yield batch.take(pa.array(rows, pa.int32())).append_column("part", pa.array(part, pa.int32()))

    urls = scratch.save(urls.mapInArrow(within, f"{urls.schema.simpleString()[7:-1].replace(':', ' ')}, part int"), "urls")
    salts = scratch.save(urls.groupBy("part").agg(F.ceil(F.count("*") / INTERVAL_ROWS).cast("int").alias("salts")), "salts")
    left = urls.join(F.broadcast(salts), "part").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.col("salts")).cast("int")).drop("salts")
    right = dealt.drop("p").mapInArrow(overlapped, "host string, path string, verdict string, key string, part int").join(F.broadcast(salts), "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        sweep = Sweep(list(zip(*(right.column(k).to_pylist() for k in ("host", "path", "verdict")))))
        return pa.table(_swept(sweep, left, default), _NAMES)

    return left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInArrow(meet, schema)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r(h, p, v) as (values {values}),
m as (select page_id, host, path, max_by(struct_pack(rule := h || p, v := v), length(h || p)) as best
  from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) and h is not null
  group by all)
select page_id, host, path, best.rule as rule, coalesce(best.v, '{DEFAULT}') as verdict from m"""
