"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker gets at once; by default little but their number is limited, and texts are long.
BATCH_BYTES = 8 << 20
#: A key is hot if it has this share of all rows, and so many; there are at most 1 / HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1 / 500, 1000
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def byte_size(value: str) -> int:
    """The bytes that a setting such as 8m, 64KB or 1048576 means."""
    digits, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([a-zA-Z]*)\s*", value).groups()
    return int(digits) * _UNITS[unit.lower().removesuffix("ib").removesuffix("b") if len(unit) > 1 else unit.lower()]


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES; a lower one stays."""
    if not 0 < byte_size(spark.conf.get(_BATCH)) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, if that is shared or there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if not spark.sparkContext.master.startswith("local") and re.match(r"(file:|/)", root):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is a local folder")
    return root.rstrip("/")


def hot_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, rows: int) -> DataFrame:
    """The inner join of big with small, whose keys are unique; ``weight`` of small counts the rows of big that have its key.

    Hot keys, of which there are at most 1 / HOT_SHARE, go to all tasks, so their rows are not gathered in one; the others
    are shuffled. ``rows`` counts the rows of big.
    """
    least = max(HOT_ROWS, int(rows * HOT_SHARE))
    hot = F.broadcast(small.where(F.col(weight) >= least))
    if not small.where(F.col(weight) >= least).limit(1).count():
        return big.join(small, on)
    cold = big.join(hot.select(*on), on, "left_anti").join(small.where(F.col(weight) < least), on)
    return big.join(hot, on).unionByName(cold)


def sieve(df: DataFrame, keep) -> DataFrame:
    """The rows of df that ``keep``, a function of mapInArrow, lets through; names of columns may hold anything, dots as well."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*df.columns)


class Scratch:
    """A private folder of Parquet tables that cut lineage and survive the loss of executors.

    ``save`` writes a table and reads it back; ``drop`` removes one that later tables no longer need.
    """

    def __init__(self, spark: SparkSession, what: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Removes all tables but these, once what a lazy result needs is in them."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(root):
            self.drop(*{f.getPath().getName() for f in fs.listStatus(root)} - {*names})

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
