from pyspark.sql import functions as F

from quarry.sources import code, derived
from quarry.sources.facts import Facts

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_kept_facts_are_those_of_the_parsers(spark, tmp_path, monkeypatch):
    src = derived.sources(spark, D).union(spark.createDataFrame([("a/.c", 7, "c", "int f( void ) { return 1; }"), ("x\\y.tar.c", 8, "c", "int f( void ) { return 1; }"), ("n.c", 9, "c", None), ("n.sol", 9, "solidity", "")], code.SOURCES))
    kept = Facts(spark, str(tmp_path / "facts"))
    assert rows(kept.functions(src)) == rows(code.functions_of(src))
    assert rows(kept.contracts(src)) == rows(code.solidity_contracts(src))
    batches_of = lambda: spark.read.option("recursiveFileLookup", "true").parquet(f"{kept.root}/v3/functions")
    # nothing is parsed twice, whatever the path, and no plan that reads facts runs Python
    batches = batches_of().select("batch").distinct().count()
    again = src.withColumn("path", F.concat(F.lit("copy/"), "path"))
    assert kept.functions(again).count() == code.functions_of(again).count()
    assert batches_of().select("batch").distinct().count() == batches == 1
    assert "Python" not in kept.functions(again)._jdf.queryExecution().toString()
    # new contents are added, and facts whose batch never ended are not read
    batches_of().withColumn("batch", F.lit("0-broken")).write.parquet(f"{kept.root}/v3/functions/0-broken")
    more = src.union(spark.createDataFrame([("new.c", 1, "c", "int g( void ) { return 2; }")], code.SOURCES))
    assert rows(kept.functions(more)) == rows(code.functions_of(more))


def test_no_sources(spark, tmp_path):
    kept = Facts(spark, str(tmp_path / "facts"))
    empty = spark.createDataFrame([], code.SOURCES)
    assert kept.functions(empty).collect() == [] and kept.contracts(empty).collect() == []
    assert kept.functions(empty).schema.simpleString() == code.functions_of(empty).schema.simpleString()


def test_parsers_get_files_by_their_bytes(spark, tmp_path):
    from quarry.operators import shared

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "256MB")
    try:
        src = spark.createDataFrame([("n.c", 9, "c", "int g( void ) { return 1; }")], code.SOURCES)
        assert Facts(spark, str(tmp_path / "facts")).functions(src).count() == 1
        assert spark.conf.get(name) == str(shared.BATCH_BYTES)
        spark.conf.set(name, "1m")
        shared.bounded_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_what_is_known_of_files_is_never_broadcast(spark, tmp_path):
    rows = [("a.sol", 0, "solidity", "contract A { uint x; function f() public { x = 1; } }")]
    found = Facts(spark, str(tmp_path)).contracts(spark.createDataFrame(rows, code.SOURCES))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1
