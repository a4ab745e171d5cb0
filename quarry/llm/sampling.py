"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: More classes than these are no grades, and their samples no bounded table.
MOST_CLASSES = 100
#: Bytes of text that the sample of a class has at most.
SAMPLE_BYTES = 16 << 20


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null ids have none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, per_class: int, columns: list[str], most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``per_class`` documents of each class (two or a few), the first by hash of their ids, with ``label`` and the columns of docs.

    A document with several labels has the least; rows of one id stay together. No document is too long as such: if the
    texts of a class have more than ``most_bytes`` bytes together, its longest go until the others have no more. Only ids
    and lengths are ordered, a table of per_class rows a class, so it is sent to the tasks.
    """
    one = labels.where(label.isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    classes = [r[0] for r in one.select("_label").distinct().limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    order = F.xxhash64("doc_id")
    parts = [one.where(F.col("_label") == c).orderBy(order, "doc_id").limit(per_class) for c in sorted(classes)]
    if not parts:
        return docs.select(*columns, F.lit(0).alias("_label")).limit(0)
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("_bytes")).join(F.broadcast(chosen), "doc_id")
    sizes = sizes.groupBy("doc_id", "_label").agg(F.sum(F.coalesce("_bytes", F.lit(0))).alias("_bytes"))
    so_far = F.sum("_bytes").over(Window.partitionBy("_label").orderBy("_bytes", order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sizes.withColumn("_so_far", so_far).where(F.col("_so_far") <= most_bytes).select("doc_id", "_label")
    return docs.join(F.broadcast(fitting), "doc_id").select(*columns, "_label")
