"""``python -m quarry.cli file [task] [mode] [format] [lang]``: audits one source file.

Exit codes: 0 done, 1 a failure inside, 2 a call that makes no sense. Task ``13`` runs all tasks and the graph, ``12``
the graph alone; without a task it is asked for.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry import api
from quarry.operators import code_graph
from quarry.plans import audit
from quarry.sources import code

OK, FAILED, USAGE = 0, 1, 2
MODES, FORMATS = ("legacy", "auditor", "explore"), ("text", "json")
GRAPH, EVERYTHING = "12", "13"
SEPARATOR = "\n    ----------------------      \n"


class UsageError(ValueError):
    pass


def tasks(language: str) -> list[str]:
    return sorted((r[0] for r in audit.RULES if api.language_of_task(r[0]) == language), key=int)


def parse(argv: list[str]) -> tuple[str, str | None, str, str, str]:
    """path, task (None: ask), mode, format, language."""
    if not argv or not argv[0]:
        raise UsageError("Error: a source file is needed.")
    path, task, mode, form, lang = [*argv, *[None] * 5][:5]
    mode, form = (mode or "legacy").lower(), (form or "text").lower()
    if not os.path.isfile(path):
        raise UsageError(f"Error: no such source file: {path}")
    if mode not in MODES:
        raise UsageError(f"Error: mode must be one of {', '.join(MODES)}.")
    if form not in FORMATS:
        raise UsageError(f"Error: format must be one of {', '.join(FORMATS)}.")
    if task is not None and not task.strip():
        raise UsageError("Error: the task is empty.")
    language = lang.lower() if lang else code.LANGUAGES.get(os.path.splitext(path)[1].lower())
    if language not in ("solidity", "c", "rust"):
        raise UsageError("Error: lang must be solidity, c or rust; give it where the suffix doesn't tell.")
    return path, task.strip() if task else None, mode, form, language


def source(spark: SparkSession, path: str, language: str) -> DataFrame:
    with open(path, "rb") as f:
        return spark.createDataFrame([(path, 0, language, f.read().decode("utf-8", "replace"))], code.SOURCES)


def run(spark: SparkSession, path: str, task: str, mode: str = "legacy", form: str = "text", language: str | None = None) -> dict:
    """Prints findings as text, or the report as JSON; returns the report."""
    began = time.perf_counter()
    language = language or parse([path])[4]
    known = tasks(language)
    if task not in (*known, GRAPH, EVERYTHING):
        raise UsageError(f"Error: task must be one of {', '.join(known)}, {GRAPH} or {EVERYTHING}.")
    src = source(spark, path, language)
    found = []
    if mode == "explore":
        for r in api.summary(src).collect():
            print(f"{r.path}: {r.functions} functions, {r.statements} statements")
    if task != GRAPH:
        rows = api.analyze(src, "all" if task == EVERYTHING else task, mode)
        found = (rows.orderBy("code", "message") if mode == "legacy" else api.render(rows).orderBy(F.col("task_id").cast("int"), "card")).collect()
    if form == "text":
        for r in found:
            print(r.asDict() if mode == "legacy" else r.card, SEPARATOR, sep="\n")
        if not found and task != GRAPH:
            print("No findings.")
    if task in (GRAPH, EVERYTHING) and form == "text":
        print("digraph {", *(r.line for r in code_graph.dot(*api.graph(src)).collect()), "}", sep="\n")
    report = {"artifact": path, "language": language, "mode": mode, "task": task, "rules_run": [] if task == GRAPH else known if task == EVERYTHING else [task], "findings_count": len(found), "graph_rendered": task in (GRAPH, EVERYTHING), "duration_ms": int((time.perf_counter() - began) * 1000)}
    if form == "json":
        print(json.dumps(report))
    return report


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        path, task, mode, form, language = parse(argv)
        if task is None:
            task = input(f"Task ({', '.join(tasks(language))}, {GRAPH} or {EVERYTHING}): ").strip()
        run(spark or SparkSession.builder.getOrCreate(), path, task, mode, form, language)
        return OK
    except UsageError as e:
        print(e)
        return USAGE
    except Exception as e:
        print(f"Error: the audit failed.\nReason: {e}")
        return FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
