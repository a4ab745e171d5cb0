"""What a caller of the audit engine uses: tasks, analysis, graph, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import adapters, code_graph, payload
from quarry.plans import audit
from quarry.sources import code

MODES = ("legacy", "auditor", "explore")
language_of_task = audit.language_of_task


class AuditError(ValueError):
    """An error with a code that callers can rely on."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def list_tasks(spark: SparkSession, language: str | None = None) -> DataFrame:
    """task_id, rule_id, confidence by number, and ``all`` last."""
    if language not in (None, "solidity", "c", "rust"):
        raise AuditError("unsupported_language", str(language))
    rows = sorted((r for r in audit.RULES if language in (None, language_of_task(r[0]))), key=lambda r: int(r[0]))
    return spark.createDataFrame([*rows, ("all", "all", "")], "task_id string, rule_id string, confidence string")


def analyze(sources: DataFrame, task: str = "all", mode: str = "auditor", catalog: DataFrame | None = None) -> DataFrame:
    """Findings of one task or all over sources, with their evidences and what a catalog (audit.full_findings) tells of the rule.

    In mode ``legacy`` just code and message.
    """
    if task != "all" and task not in {r[0] for r in audit.RULES}:
        raise AuditError("unknown_task", task)
    if mode not in MODES:
        raise AuditError("unknown_mode", mode)
    if task != "all":
        sources = sources.where(F.col("language") == language_of_task(task))
    one = None if task == "all" else task
    if mode == "legacy":
        return audit.findings(sources, one).select(F.col("task_id").cast("int").alias("code"), "message")
    return audit.full_findings(sources, catalog, one)


def graph(sources: DataFrame, bundle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Checked nodes and edges of each file, of all languages; with the name of a bundle those of all files in one graph, joined by imports."""
    nodes, edges = payload.payload(*adapters.model(sources))
    if bundle is None:
        return nodes, edges
    return payload.bundle(nodes, edges, bundle, code_graph.imports(sources).withColumn("label", F.lit("import")))


def graph_hints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per C file how large its graph is and whether it is slow to lay out."""
    return payload.hints(nodes, edges)


def summary(sources: DataFrame) -> DataFrame:
    """Per file its functions and statements; files without functions have none."""
    functions = code.functions_of(sources)
    per = code.statements_of(functions).groupBy("path").agg(F.count("*").alias("statements"), F.count_distinct("fn_ord").alias("with_statements"))
    n = functions.groupBy("path").agg(F.count("*").alias("functions"))
    out = sources.select("path", "language").join(n, "path", "left").join(per, "path", "left")
    return out.select("path", "language", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("statements", F.lit(0)).alias("statements"))


def render(findings: DataFrame) -> DataFrame:
    """path, task_id and card: each finding of ``analyze`` as text, a line for each thing that is told of it."""
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    lines = lambda e: F.when(F.size(e["line_numbers"]) > 0, F.array_join(e["line_numbers"].cast("array<string>"), ", ")).otherwise("")
    proof = lambda e: F.concat_ws("\n", F.concat(F.lit("Evidence: "), e["summary"]), line("Type", e["type_name"]), line("Function", e["function_name"]), line("Statement", e["statement"]), line("Lines", lines(e)), line("Reason", e["confidence_reason"]))
    head = F.concat(F.lit("[Task "), "task_id", F.lit("] "), "title")
    always = [F.concat(F.lit(f"{name}: "), c) for name, c in (("Category", "category"), ("Portability", "portability"), ("Confidence", "confidence"), ("Message", "message"))]
    card = F.concat_ws("\n", head, *always, line("Hint", F.col("remediation_hint")), F.array_join(F.transform("evidences", proof), "\n"))
    return findings.select("path", "task_id", card.alias("card"))
