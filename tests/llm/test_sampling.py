from pyspark.sql import functions as F

from quarry.llm.sampling import labelled_sample


def test_only_the_total_bounds_a_class(spark):
    """A long text is taken whole where the class's bytes suffice; else the longest go first, whatever their order."""
    texts = {1: "a" * 500_000, 2: "bb", 3: "ccc", 4: "é" * 10, 5: None, 6: "f" * 40, 7: "g" * 70}
    docs = spark.createDataFrame([*texts.items(), (6, "f" * 40), (8, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (6, 1), (7, 0), (None, 1), (9, 1)], "doc_id long, y int")

    def taken(most):
        return sorted((r.doc_id, r._label) for r in labelled_sample(docs, labels, F.col("y"), 50, ["doc_id"], most).collect())

    assert taken(1 << 20) == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (6, 0), (7, 0)]
    # 4 has 20 bytes, both rows of 6 have 80, 7 has 70: 20 + 70 fit into 100, 80 more don't
    assert taken(100) == [(2, 1), (3, 1), (4, 0), (5, 0), (7, 0)]
    assert taken(0) == [(5, 0)]
    assert labelled_sample(docs, labels.limit(0), F.col("y"), 50, ["doc_id"]).count() == 0


def test_rows_of_a_class(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("y"))
    got = labelled_sample(docs, labels, F.col("y"), 20, ["doc_id"]).groupBy("_label").count().collect()
    assert sorted((r._label, r["count"]) for r in got) == [(0, 20), (1, 20), (2, 20)]
