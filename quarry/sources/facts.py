"""What the parsers find in files, kept once.

Tables of functions and contracts by digest of the content, language and version of the parser. A file whose content is known
is never parsed again, whatever its path, so all rules, evidence and graphs of a run, and of later runs, read what one pass of
the parsers wrote. New contents are appended; a row of ``done`` follows its facts, so facts that can be read are complete.
Every batch has a folder of its own, so writers don't
meet; of batches that hold the same content the first by name is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import text as T
from quarry.operators import shared
from quarry.sources import code

#: Goes up with every change of what the parsers find.
VERSION = 3
DONE = "digest string, language string, batch string"
_KINDS = {"functions": (code.functions_of, code.FUNCTIONS, ("c", "rust")), "contracts": (code.solidity_contracts, code.CONTRACTS, ("solidity",))}
#: Columns that depend on the path, not on the content.
_OF_PATH = ("path", "file_ord", "type_name")


class Facts:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared.root(spark)}/quarry-facts"

    def _table(self, name: str, schema) -> DataFrame:
        path = f"{self.root}/v{VERSION}/{name}"
        if shared.exists(self.spark, path):
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        return self.spark.createDataFrame([], schema)

    def _of(self, kind: str, sources: DataFrame) -> DataFrame:
        parse, schema, languages = _KINDS[kind]
        digest = F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest")
        files = sources.where(F.col("language").isin(*languages))
        named = files.select("path", "file_ord", "language", digest)
        new = files.select(digest, "language", "content").join(shared.shuffled(self._table(f"{kind}-done", DONE)), ["digest", "language"], "left_anti").dropDuplicates(["digest", "language"])
        fields = [x.split(" ", 1) for x in schema.split(", ")]
        own = [c for c, _ in fields if c not in _OF_PATH or (c == "type_name" and kind == "contracts")]
        kept = ", ".join(f"{c} {t}" for c, t in fields if c in own)
        kept = f"digest string, batch string, {kept}" if "language" in own else f"digest string, batch string, language string, {kept}"
        if new.limit(1).count():
            shared.bounded_batches(self.spark)
            batch = uuid.uuid4().hex
            parsed = parse(new.select(F.col("digest").alias("path"), F.lit(0).alias("file_ord"), "language", "content"))
            rows = parsed.select(F.col("path").alias("digest"), F.lit(batch).alias("batch"), *([] if "language" in own else [F.lit(languages[0]).alias("language")]), *own)
            rows.write.parquet(f"{self.root}/v{VERSION}/{kind}/{batch}")
            new.select("digest", "language", F.lit(batch).alias("batch")).write.parquet(f"{self.root}/v{VERSION}/{kind}-done/{batch}")
        first = self._table(f"{kind}-done", DONE).groupBy("digest", "language").agg(F.min("batch").alias("batch"))
        facts = self._table(kind, kept).join(shared.shuffled(first), ["digest", "language", "batch"], "left_semi")
        stem = F.regexp_replace(T.basename(F.col("path")), r"(?s)^(.+)\.[^.]*$", "$1").alias("type_name")
        return facts.join(shared.shuffled(named), ["digest", "language"]).select(*[stem if c == "type_name" and kind == "functions" else F.col(c) for c, _ in fields])

    def functions(self, sources: DataFrame) -> DataFrame:
        """As code.functions_of."""
        return self._of("functions", sources)

    def contracts(self, sources: DataFrame) -> DataFrame:
        """As code.solidity_contracts."""
        return self._of("contracts", sources)
