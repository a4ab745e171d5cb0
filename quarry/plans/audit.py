"""Audit queries: alerts, findings with evidence, counts; over any table of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions import text as T
from quarry.operators import adapters, c_rules, evidence, payload, rust_rules, solidity_rules
from quarry.operators.shared import Rounds, shuffled
from quarry.sources import code, derived
from quarry.sources.facts import Facts

#: task, slug, confidence
RULES = (
    ("1", "contract_version", "low"),
    ("2", "unallowed_manipulation", "medium"),
    ("3", "staking", "medium"),
    ("4", "pool_interactions", "medium"),
    ("5", "local_points", "medium"),
    ("6", "exceptions", "medium"),
    ("7", "complicated_calculations", "low"),
    ("8", "check_order", "medium"),
    ("9", "withdraw_check", "medium"),
    ("10", "similar_names", "low"),
    ("11", "outer_calls", "medium"),
    ("101", "non_saturating_float_cast", "medium"),
    ("102", "unsafe_shift_external_exponent", "high"),
    ("103", "unchecked_return_sensitive", "high"),
    ("104", "shared_mem_uaf_pool", "medium"),
    ("105", "incomplete_reserved_account_list", "medium"),
    ("106", "sysvar_decode_callback_type_mismatch", "high"),
    ("107", "bitwise_flag_normalization_mismatch", "high"),
    ("108", "quic_invisible_frame_limit", "high"),
    ("109", "quic_handshake_eviction_missing", "high"),
    ("110", "bank_lifecycle_refcount_concurrency", "medium"),
    ("111", "io_uring_submission_race_funk", "low"),
    ("112", "alt_resolution_window_mismatch", "high"),
    ("113", "keyswitch_atomicity_violation", "high"),
    ("114", "bls_aggregate_rogue_key_check", "high"),
    ("115", "unsupported_program_id_divergence", "high"),
    ("116", "signed_integer_overflow_consensus", "high"),
    ("117", "unspecified_evaluation_order_side_effects", "medium"),
    ("118", "protocol_struct_padding_mismatch", "high"),
    ("119", "division_rounding_divergence", "high"),
    ("120", "unaligned_memory_access_ebpf", "high"),
    ("201", "missing_auth_check", "medium"),
    ("202", "unbounded_instance_storage_growth", "low"),
    ("203", "unhandled_cross_contract_failure", "medium"),
    ("204", "dangerous_raw_val_conversion", "low"),
    ("205", "missing_ttl_extension", "low"),
    ("206", "improper_error_signaling", "high"),
    ("207", "resource_limit_exhaustion_loop", "medium"),
    ("208", "constructor_reinitialization_risk", "low"),
    ("209", "undocumented_unsafe_block", "medium"),
    ("210", "static_mut_ref_access", "high"),
    ("211", "interior_mutability_sync_violation", "low"),
    ("212", "unprotected_panic_in_public_api", "medium"),
    ("213", "redundant_arc_clone_in_loop", "low"),
    ("214", "missing_async_fn_trait_bound", "low"),
    ("215", "temporary_lifetime_extension_confusion", "low"),
    ("216", "forbidden_std_usage", "high"),
    ("217", "non_deterministic_state_root", "low"),
    ("218", "async_boundary_panic_leak", "low"),
    ("219", "serde_binary_codec_mismatch", "low"),
    ("220", "divergent_fork_choice_assumptions", "low"),
    ("221", "gas_limit_cl_el_mismatch", "low"),
    ("222", "unbounded_proposal_range", "low"),
    ("223", "tee_side_channel_via_panic", "medium"),
)


def language_of_task(task: str) -> str:
    return "solidity" if int(task) < 100 else "c" if int(task) < 200 else "rust"


def alerts(sources: DataFrame, task: str | None = None) -> DataFrame:
    """All alerts of the rules of each file's language; with a task those of its rule, and nothing else is computed."""
    kept = Facts(sources.sparkSession)
    by_language = {
        "c": lambda: c_rules.c_alerts(sources, code.statements_of(kept.functions(sources.where("language = 'c'"))), task),
        "solidity": lambda: solidity_rules.solidity_alerts(sources, task, kept.contracts(sources)),
        "rust": lambda: rust_rules.rust_alerts(sources, lambda: kept.functions(sources.where("language = 'rust'")), task),
    }
    if task is not None:
        return by_language[language_of_task(task)]()
    return by_language["c"]().unionByName(by_language["solidity"]()).unionByName(by_language["rust"]())


def _told(found: DataFrame) -> DataFrame:
    """Alerts with their rule's name, confidence and message."""
    rules = found.sparkSession.createDataFrame(RULES, "task_id string, rule_id string, confidence string")
    message = F.concat_ws(": ", "rule_id", F.nullif("function_name", F.lit("")), F.nullif("detail", F.lit("")), F.nullif("statement", F.lit("")))
    return found.join(F.broadcast(rules), "task_id").withColumn("message", message)


def model_index(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What messages may name: statements of functions (for evidence.infer: index), and functions of types in their files' order."""
    kept = Facts(sources.sparkSession)
    plain = kept.functions(sources).select("path", F.lit(0).alias("type_ord"), "type_name", "fn_ord", "fn_name", "body")
    contracts = kept.contracts(sources).join(shuffled(sources.select("path", "content")), "path")
    at = F.greatest(*[F.instr("content", F.concat(F.lit(f"{word} "), F.col("type_name"))) for word in ("contract", "library", "interface")])
    both = plain.unionByName(contracts.select("path", at.alias("type_ord"), "type_name", "fn_ord", "fn_name", "body"))
    key_ord = F.col("type_ord").cast("long") * (1 << 20) + F.col("fn_ord")
    index = both.select("path", key_ord.alias("key_ord"), "type_name", F.col("fn_name").alias("function_name"), F.posexplode_outer(T.statements(F.col("body"))).alias("ord", "source_statement"), F.lit(None).cast("string").alias("reason"))
    return index, both.drop("body")


def full_findings(sources: DataFrame, catalog: DataFrame | None = None, task: str | None = None) -> DataFrame:
    """Findings with everything that a report shows: evidences, and title, category, portability and hint of their rule.

    catalog: task_id, title, category, portability, remediation_hint; rules that it lacks have a title made from their name
    and blanks.
    """
    shown = ("title", "category", "portability", "remediation_hint")
    found = _told(alerts(sources, task))
    if catalog is None:
        found = found.withColumns({c: F.lit(None).cast("string") for c in shown})
    else:
        # one row a rule, and there are fewer rules than RULES has
        known = F.broadcast(catalog.where(F.col("task_id").isin([r[0] for r in RULES])).dropDuplicates(["task_id"]).select("task_id", *shown))
        found = found.join(known, "task_id", "left")
    found = found.withColumns({"title": F.coalesce("title", F.initcap(F.replace("rule_id", F.lit("_"), F.lit(" ")))), **{c: F.coalesce(c, F.lit("")) for c in shown[1:]}})
    order = Window.partitionBy("path").orderBy(F.col("task_id").cast("int"), "fn_ord", "idx", "detail", "statement")
    found = found.withColumn("alert_id", F.concat("path", F.lit("#"), F.row_number().over(order)))
    keep = ("alert_id", "path", "task_id", "rule_id", "confidence", "message", *shown)
    # alerts meet statements, names and lines; they are computed once
    found = Rounds(sources.sparkSession, "findings").save(found.select(*keep))
    told = evidence.infer(found, *model_index(sources), code.lines_of(sources))
    one = F.struct(*evidence.EVIDENCE)
    return told.select("path", "task_id", F.col("task_id").cast("int").alias("legacy_code"), "rule_id", "title", "category", "portability", "confidence", "message", "remediation_hint", F.array(one).alias("evidences"))


def findings(sources: DataFrame, task: str | None = None) -> DataFrame:
    """Alerts with their rule's description and the lines of the file that hold their statement; of one task or of all."""
    found = Rounds(sources.sparkSession, "findings").save(_told(alerts(sources, task)))
    lines = code.lines_of(sources).select("path", "n", "line")
    held = found.where("statement <> ''").select("path", "statement").distinct().join(shuffled(lines), "path").where(F.contains("line", F.col("statement")))
    at = held.groupBy("path", "statement").agg(F.sort_array(F.collect_list("n")).alias("line_numbers"))
    out = found.join(at, ["path", "statement"], "left").withColumn("line_numbers", F.coalesce("line_numbers", F.array().cast("array<int>")))
    return out.select("path", "task_id", "rule_id", "confidence", "function_name", "idx", "message", F.coalesce(F.try_element_at("line_numbers", F.lit(1)), F.lit(0)).alias("line_number"), F.array_join(F.col("line_numbers").cast("array<string>"), ",").alias("line_numbers"))


def corpus_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings over the sources derived from suppliers."""
    return findings(derived.sources(spark, sf_dir))


def corpus_findings_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(derived.sources(spark, sf_dir)).groupBy("task_id").agg(F.count("*").alias("findings"))


def corpus_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the findings over the sources derived from suppliers are about."""
    found = full_findings(derived.sources(spark, sf_dir)).select("path", "task_id", "title", F.explode("evidences").alias("e"))
    return found.select("path", "task_id", "title", "e.type_name", "e.function_name", "e.statement", "e.confidence_reason", "e.line_number")


def corpus_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Facts(spark).functions(derived.sources(spark, sf_dir)).select("path", "fn_ord", "fn_name", "visibility")


def corpus_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked nodes of the derived files of all languages."""
    nodes = payload.nodes_of(*adapters.model(derived.sources(spark, sf_dir)))
    return nodes.select("path", "id", "group", "label", "parent", "kind", "is_entrypoint", F.size("write_paths").alias("write_paths"))


def corpus_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked edges of the derived files of all languages."""
    edges = payload.edges_of(*adapters.model(derived.sources(spark, sf_dir)))
    return edges.select("path", "source", "target", "kind", "label", "callsite", F.size("args_map").alias("args"), "confidence")


QUERIES = {f.__name__: f for f in (corpus_findings, corpus_findings_by_task, corpus_evidence, corpus_functions, corpus_graph_nodes, corpus_graph_edges)}


def _functions_sql(kind: str) -> str:
    order = "row_number() over (partition by path order by i)"
    return f"with {derived.sql(kind)}, {derived.functions_sql(kind)} select path, ({order} - 1)::int as fn_ord, name as fn_name, visibility from t"


SQL: dict[str, str] = {"corpus_functions": f"select * from ({_functions_sql('c')}) union all select * from ({_functions_sql('contract')})"}
