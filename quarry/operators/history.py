"""A history of artifacts and scans as append-only Parquet tables.

Nothing is rewritten: a soft deletion appends a tombstone, and reads take it into account. Ids follow the ones there are, in
an order that the rows decide, so the same upload twice gives the same table. Every change is a commit (commits.Log), so
several writers can work at once: no id is given twice and no content is stored twice.
"""

from __future__ import annotations

import hashlib
import json
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions import text as T
from quarry.operators import keyed
from quarry.operators.commits import Log
from quarry.operators.frames import ranked
from quarry.sources.code import LANGUAGES

ARTIFACT = "id long, sha256 string, filename string, language string, size_bytes long, created_at string"
SCAN = "id long, artifact_id long, mode string, task string, rules_run string, findings_count int, duration_ms int, tool_version string, status string, error_code string, created_at string, rules_catalog_hash string, error_message string"
FINDING = "scan_id long, ord int, rule_id string, type_name string, function_name string, source_statement string, statement string, message string"
TOMBSTONE = "scan_id long, deleted_at string"
CONTENT = "sha256 string, content binary"
#: A graph's nodes and edges as JSON, in parts.
GRAPH = "scan_id long, part string, body string"

#: Limits of uploads.
MAX_BYTES, MAX_PARTS = 2 << 20, 32


def upload_status(content: str, filename: str):
    """ok, or why a file is not taken."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size == 0, "empty_file").when(~T.extension(F.col(filename)).isin(*LANGUAGES), "unsupported_extension").when(size > MAX_BYTES, "too_large").otherwise("ok")


def language_of(filename, explicit=None):
    """The language asked for, lower-cased, else that of the suffix, else null."""
    out = F.lit(None).cast("string")
    for suffix, name in LANGUAGES.items():
        out = F.when(T.extension(filename) == suffix, name).otherwise(out)
    return out if explicit is None else F.coalesce(F.nullif(F.lower(explicit), F.lit("")), out)


def bundles(parts: DataFrame) -> DataFrame:
    """Per bundle of parts (bundle, filename, content): status, language, digest and members.

    A name that occurs again gets _2, _3, ... before its suffix; the digest doesn't depend on the order of the parts.
    """
    base = T.basename(F.col("filename"))
    n = F.row_number().over(Window.partitionBy("bundle", base).orderBy(F.sha2("content", 256), "filename"))
    named = F.when(n == 1, base).otherwise(F.concat(F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 1), F.lit("_"), n, F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 2)))
    df = parts.select("bundle", named.alias("name"), F.col("content"), upload_status("content", "filename").alias("part_status"), language_of(F.col("filename")).alias("language"))
    out = df.groupBy("bundle").agg(F.count("*").alias("parts"), F.max(F.when(F.col("part_status") != "ok", F.col("part_status"))).alias("bad"), F.count_distinct("language").alias("languages"), F.max("language").alias("language"), keyed.set_digest(F.col("name"), F.col("content")).alias("digest"), F.collect_list(F.struct(F.col("name").alias("path"), F.sha2("content", 256).alias("sha256"))).alias("files"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))
    status = F.when(F.col("parts") > MAX_PARTS, "too_many_files").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("languages") != 1, "mixed_languages").otherwise("ok")
    # members of a bundle are few: MAX_PARTS bounds those that are taken
    first, others = F.split_part("members", F.lit(","), F.lit(1)), F.col("parts") - 1
    label = F.concat(F.lit("bundle:"), first, F.when(others > 0, F.concat(F.lit(" (+"), others.cast("string"), F.lit(" more)"))).otherwise(""))
    manifest = F.to_json(F.struct(F.lit(1).alias("version"), "language", F.array_sort("files").alias("members")))
    return out.select("bundle", status.alias("status"), "language", "digest", "members", label.alias("filename"), manifest.alias("manifest"))


def tool_version(explicit: str | None = None, root: str = ".") -> str:
    """The version given, else the commit checked out in a folder, else ``unknown``."""
    if explicit and explicit.strip():
        return explicit.strip()
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=3)
    except (OSError, subprocess.TimeoutExpired):
        return "unknown"
    return out.stdout.strip() or "unknown" if out.returncode == 0 else "unknown"


def catalog_hash(*catalogs) -> str:
    """sha256 over the given catalogs' JSON, one after the other; empty without any."""
    if not catalogs:
        return ""
    return hashlib.sha256("".join(json.dumps(c, sort_keys=True, separators=(",", ":")) for c in catalogs).encode()).hexdigest()


class History:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    def table(self, name: str, schema: str) -> DataFrame:
        return self.log.read(name, schema)

    @property
    def artifacts(self) -> DataFrame:
        return self.table("artifact", ARTIFACT)

    def scans(self, include_deleted: bool = False) -> DataFrame:
        gone = self.table("tombstone", TOMBSTONE).groupBy("scan_id").agg(F.min("deleted_at").alias("deleted_at"))
        df = self.table("scan", SCAN).join(gone.withColumnRenamed("scan_id", "id"), "id", "left")
        return df if include_deleted else df.where("deleted_at is null")

    def ingest(self, uploads: DataFrame, now: str) -> DataFrame:
        """Takes uploads (ord, filename, content): per upload its status, digest and artifact id; known contents are not stored again."""
        df = uploads.select("ord", F.coalesce(F.nullif(T.basename(F.col("filename")), F.lit("")), F.lit("source")).alias("filename"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), upload_status("content", "filename").alias("status"), language_of(F.col("filename")).alias("language"))
        first = keyed.first_wins(df.where("status = 'ok'"), ["sha256"], ["ord"], "ord", "filename", "language", "size_bytes")

        def change(ids: dict[str, int]) -> dict[str, DataFrame]:
            new = ranked(first.join(self.artifacts.select("sha256"), "sha256", "left_anti"), ["ord", "sha256"], "nth")
            last, n = ids.get("artifact", 0), new.count()
            if not n:
                return {}
            ids["artifact"] = last + n
            kept = uploads.select(F.sha2("content", 256).alias("sha256"), F.col("content").cast("binary").alias("content")).join(new.select("sha256"), "sha256", "left_semi").dropDuplicates(["sha256"])
            return {"content": kept, "artifact": new.select((F.col("nth") + last).cast("long").alias("id"), "sha256", "filename", "language", "size_bytes", F.lit(now).alias("created_at"))}

        self.log.commit(change)
        return df.join(self.artifacts.select("sha256", F.col("id").alias("artifact_id")), "sha256", "left").select("ord", "status", "sha256", F.when(F.col("status") == "ok", F.col("artifact_id")).alias("artifact_id"))

    def record(self, scan: DataFrame, findings: DataFrame) -> None:
        names = [x.split()[0] for x in SCAN.split(", ")]
        blank = " or ".join(f"{c} is null" for c in ("id", "artifact_id", "mode", "task", "status", "created_at"))
        if not {*names} <= {*scan.columns} or scan.where(blank).limit(1).count():
            raise ValueError("missing_field")

        def change(ids: dict[str, int]) -> dict[str, DataFrame]:
            ids["scan"] = max(ids.get("scan", 0), scan.agg(F.max("id")).first()[0] or 0)
            return {"finding": findings.select(*[x.split()[0] for x in FINDING.split(", ")]), "scan": scan.select(*names)}

        self.log.commit(change)

    def artifact(self, ident: int) -> DataFrame:
        """The artifact of an id; an error (``not_found``) where there is none."""
        found = self.artifacts.where(F.col("id") == ident)
        if not found.limit(1).count():
            raise LookupError(f"not_found: artifact {ident}")
        return found

    def by_digest(self, sha256: str) -> DataFrame:
        return self.artifacts.where(F.col("sha256") == sha256)

    def source(self, artifact_id: int) -> DataFrame:
        """The stored content of an artifact as a table of sources."""
        found = self.artifact(artifact_id).join(self.table("content", CONTENT), "sha256")
        return found.select(F.col("filename").alias("path"), F.lit(0).alias("file_ord"), "language", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))

    def _save(self, scan: tuple, findings: DataFrame, graph: tuple[DataFrame, DataFrame] | None = None) -> int:
        """Keeps a scan (the fields of SCAN but id) with what belongs to it, under the next id."""
        names = [x.split()[0] for x in FINDING.split(", ")]

        def change(ids: dict[str, int]) -> dict[str, DataFrame]:
            ids["scan"] = ident = ids.get("scan", 0) + 1
            own = F.lit(ident).cast("long").alias("scan_id")
            out = {"finding": findings.withColumn("scan_id", F.lit(ident).cast("long")).select(*names), "scan": self.spark.createDataFrame([(ident, *scan)], SCAN)}
            if graph:
                parts = [df.select(own, F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("body")) for part, df in zip(("node", "edge"), graph)]
                out["graph"] = parts[0].unionByName(parts[1])
            return out

        return self.log.commit(change)["scan"]

    def save_ok(self, artifact_id: int, mode: str, task: str, findings: DataFrame, now: str, rules_run: list[str], version: str = "unknown", catalog: str = "", duration_ms: int = 0, graph: tuple[DataFrame, DataFrame] | None = None) -> int:
        """Keeps a scan that went well, with its findings (the columns of FINDING but scan_id) and its graph if there is one; its id."""
        self.artifact(artifact_id)
        return self._save((artifact_id, mode, task, json.dumps(rules_run), findings.count(), duration_ms, version, "ok", "", now, catalog, ""), findings, graph)

    def save_failed(self, artifact_id: int, mode: str, task: str, error: Exception, now: str, version: str = "unknown", catalog: str = "") -> int:
        """Keeps that a scan failed, with the error's code and text and no findings; its id."""
        self.artifact(artifact_id)
        return self._save((artifact_id, mode, task, "[]", 0, 0, version, "error", getattr(error, "code", "internal_error"), now, catalog, str(error)), self.spark.createDataFrame([], FINDING))

    def _live(self, scan_id: int) -> None:
        if not self.scans().where(F.col("id") == scan_id).limit(1).count():
            raise LookupError(f"not_found: scan {scan_id}")

    def get_findings(self, scan_id: int) -> DataFrame:
        self._live(scan_id)
        return self.table("finding", FINDING).where(F.col("scan_id") == scan_id).drop("scan_id").orderBy("ord")

    def get_graph(self, scan_id: int) -> DataFrame | None:
        """The nodes and edges (part, body: JSON) of a scan, or None where it was kept without a graph."""
        self._live(scan_id)
        found = self.table("graph", GRAPH).where(F.col("scan_id") == scan_id).select("part", "body")
        return found if found.limit(1).count() else None

    def export_graph(self, scan_id: int, now: str) -> DataFrame | None:
        """A line of JSON for each node and edge of a scan, with the time of the export."""
        found = self.get_graph(scan_id)
        return None if found is None else found.select(F.to_json(F.struct(F.lit(now).alias("exported_at"), "part", "body")).alias("line"))

    def soft_delete(self, scan_id: int, now: str) -> bool:
        """Whether there was such a scan, not yet deleted."""
        done = []

        def change(ids: dict[str, int]) -> dict[str, DataFrame]:
            done[:] = [self.scans().where(F.col("id") == scan_id).limit(1).count() == 1]
            return {"tombstone": self.spark.createDataFrame([(scan_id, now)], TOMBSTONE)} if done[0] else {}

        self.log.commit(change)
        return done[0]

    def list_artifacts(self, n: int = 50) -> DataFrame:
        return keyed.newest(self.artifacts, "created_at", "id", n)

    def list_scans(self, artifact_id: int | None = None, n: int = 50, include_deleted: bool = False) -> DataFrame:
        df = self.scans(include_deleted)
        return keyed.newest(df if artifact_id is None else df.where(F.col("artifact_id") == artifact_id), "created_at", "id", n)

    def scan_details(self, scan_id: int) -> DataFrame:
        return self.scans().where(F.col("id") == scan_id).join(self.artifacts.select(F.col("id").alias("artifact_id"), "filename", "language"), "artifact_id", "left")

    def diff(self, a: int, b: int) -> DataFrame:
        """Keys of findings that scan b adds to or lacks against scan a, and those in both; scans of one artifact only."""
        owners = self.scans(True).where(F.col("id").isin(a, b)).select("artifact_id").distinct().count()
        if owners != 1:
            raise ValueError("artifact_mismatch")
        key = F.coalesce(F.nullif("source_statement", F.lit("")), F.col("statement")).alias("evidence")
        rows = self.table("finding", FINDING).select("scan_id", "rule_id", "type_name", "function_name", key, "message", "ord")
        keys = ["rule_id", "type_name", "function_name", "evidence", "message"]
        return keyed.diff(rows.where(F.col("scan_id") == a), rows.where(F.col("scan_id") == b), keys, "ord").select(*keys, "change")
