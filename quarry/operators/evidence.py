"""Evidence of alerts: the statement, function or type of the model that a message names, and its lines.

Candidates of all kinds meet the alerts of their file in equality joins on the path, each with a rank, and the least rank
of an alert is kept: a partial aggregation. Ranks, best first: per function of the index, in its order, its statements in
their order and then its qualified name; then functions by their bare names, by type and place; then the last type named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators.shared import shuffled

EVIDENCE = ("kind", "summary", "type_name", "function_name", "statement", "source_statement", "confidence_reason", "line_number", "line_numbers")


def told(message: Column) -> Column:
    """The statement that a message itself gives: what follows ``line:``, else its last part between single quotes, else nothing."""
    quoted = F.regexp_extract_all(message, F.lit("'([^']+)'"), 1)
    after = F.trim(F.substring(message, F.instr(message, "line:") + 5, F.length(message)))
    return F.when(F.contains(message, F.lit("line:")), after).otherwise(F.coalesce(F.get(quoted, F.size(quoted) - 1), F.lit("")))


def lines_holding(wanted: DataFrame, lines: DataFrame, statement: str = "source_statement") -> DataFrame:
    """Per (path, statement) the sorted numbers of the lines of its file that hold it; blank statements are in no line."""
    held = wanted.where(F.trim(statement) != "").select("path", statement).distinct().join(shuffled(lines.select("path", "n", "line")), "path")
    return held.where(F.contains("line", F.trim(statement))).groupBy("path", statement).agg(F.sort_array(F.collect_set("n")).alias("line_numbers"))


def infer(alerts: DataFrame, index: DataFrame, functions: DataFrame, lines: DataFrame) -> DataFrame:
    """alerts (path, message, ...; unique by ``alert_id``) with the columns EVIDENCE.

    index: path, key_ord, type_name, function_name, ord, source_statement, reason; functions: path, type_ord, type_name,
    fn_ord, fn_name (a type without functions has a row with a null name); lines: path, n, line.
    """
    found = shuffled(alerts.select("alert_id", "path", "message"))
    rank = lambda *c: F.struct(*[(F.lit(x) if isinstance(x, int) else x).cast("long").alias(f"r{i}") for i, x in enumerate(c)]).alias("rank")
    pick = lambda t, f, s, reason: F.struct(t.alias("type_name"), f.alias("function_name"), s.alias("matched"), reason.alias("reason")).alias("pick")
    none = F.lit(None).cast("string")
    held = lambda c: F.contains("message", c)
    statements = found.join(index, "path").where((F.coalesce("source_statement", F.lit("")) != "") & held(F.col("source_statement")))
    statements = statements.select("alert_id", rank(0, F.col("key_ord"), 0, F.col("ord")), pick(F.col("type_name"), F.col("function_name"), F.col("source_statement"), F.coalesce("reason", F.lit("matched_statement_from_normalized_model"))))
    keys = found.join(index.select("path", "key_ord", "type_name", "function_name").distinct(), "path").where(held(F.concat_ws(".", "type_name", "function_name")))
    keys = keys.select("alert_id", rank(0, F.col("key_ord"), 1, 0), pick(F.col("type_name"), F.col("function_name"), none, F.lit("matched_qualified_function_name")))
    names = found.join(functions, "path")
    bare = names.where(held(F.col("fn_name"))).select("alert_id", rank(1, F.col("type_ord"), F.col("fn_ord"), 0), pick(F.col("type_name"), F.col("fn_name"), none, F.lit("matched_function_name")))
    types = names.where(held(F.col("type_name"))).select("alert_id", rank(2, -F.col("type_ord"), 0, 0), pick(F.col("type_name"), F.lit(""), none, F.lit("matched_type_name")))
    best = statements.union(keys).union(bare).union(types).groupBy("alert_id").agg(F.min_by("pick", "rank").alias("pick"))
    out = alerts.join(best, "alert_id", "left").withColumn("source_statement", F.coalesce("pick.matched", told(F.col("message"))))
    out = out.join(lines_holding(out, lines), ["path", "source_statement"], "left")
    return out.select(
        *alerts.columns,
        F.lit("message").alias("kind"),
        F.col("message").alias("summary"),
        F.coalesce("pick.type_name", F.lit("")).alias("type_name"),
        F.coalesce("pick.function_name", F.lit("")).alias("function_name"),
        F.col("source_statement").alias("statement"),
        "source_statement",
        F.coalesce("pick.reason", F.lit("message_only_fallback")).alias("confidence_reason"),
        F.coalesce(F.get("line_numbers", F.lit(0)), F.lit(0)).alias("line_number"),
        F.coalesce("line_numbers", F.array().cast("array<int>")).alias("line_numbers"),
    )


def merge_alerts(alerts: DataFrame, order: list[str]) -> DataFrame:
    """One row for each code and message (line ends as spaces, trimmed), the first by ``order``."""
    message = F.trim(F.replace("message", F.lit("\n"), F.lit(" ")))
    others = [c for c in alerts.columns if c not in ("code", "message")]
    first = alerts.withColumn("message", message).groupBy("code", "message").agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_f"))
    return first.select("code", "message", *[F.col(f"_f.{c}").alias(c) for c in others])
