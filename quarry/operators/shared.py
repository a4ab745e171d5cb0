"""Tables in the folder that driver and executors share: rounds of iterations, and facts that are kept."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse; a local warehouse serves one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and re.match(r"(file:|/)", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is a local folder")
    return f"{warehouse}/_shared"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


#: Bytes of rows that a Python worker gets at once; by default only their number is limited, and files are long.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shuffled(df: DataFrame) -> DataFrame:
    """df, never sent whole to the driver and all tasks by the join that it goes into.

    Texts that a plan puts together, lines and rows from compressed files are taken for far smaller than they are.
    """
    return df.hint("merge")


class Rounds:
    """Tables of an iteration: each is written and read again, so that plans don't pile up and lost executors cost one round."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.n = spark, f"{root(spark)}/{what}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, keep: int = 1) -> DataFrame:
        """df as written; of the tables before, the last ``keep`` stay, since the plan of what comes next may read them."""
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        if self.n - keep >= 0:
            remove(self.spark, f"{self.base}/{self.n - keep}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)
