"""What a viewer of graphs and scans sees: checked payloads, hints on size, filters, badges, rings and formatted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators import keyed

# Groups and kinds that graphs of C may have, other names of them, and kinds that are found by patterns only.
NODE_GROUPS = ["tile", "function", "workspace", "global_state", "syscall", "external"]
EDGE_KINDS = ["function_to_function", "function_to_workspace", "function_to_include_template", "tile_to_tile", "function_to_syscall", "pointer_flow"]
GROUP_ALIASES = {"type": "tile", "state": "workspace"}
KIND_ALIASES = {"function_to_system": "function_to_syscall"}
HEURISTIC_KINDS = ["pointer_flow", "function_to_function", "function_to_workspace", "function_to_include_template"]
#: More nodes or edges than these are slow to lay out.
MANY_NODES, MANY_EDGES = 4000, 12000


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    out = c
    for name, other in aliases.items():
        out = F.when(c == name, other).otherwise(out)
    return out


def edge_facts(kind: Column) -> list[Column]:
    """Whether edges of a kind are guesses, and how sure they are."""
    guess = F.coalesce(F.trim(kind), F.lit("")).isin(HEURISTIC_KINDS)
    return [guess.alias("is_heuristic"), F.when(guess, "heuristic").otherwise("high").alias("confidence")]


def normalize(nodes: DataFrame, edges: DataFrame, c_profile: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, group, ord) and edges (id, source, target, kind, ord) that a payload may hold.

    Blank ids go, of equal ids the first by ``ord`` stays, edges need both ends. In graphs of C, names become canonical;
    what is still unknown becomes ``external`` or ``pointer_flow`` and keeps its name in ``experimental``. The result is
    a fixed point, so a merged bundle is checked again by the same call.
    """
    nodes = keyed.first_wins(nodes.where("id <> ''"), ["id"], ["ord"], "group", "ord")
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    edges = keyed.first_wins(edges.where("id <> ''"), ["id"], ["ord"], "source", "target", "kind", "ord")
    none = F.lit(None).cast("string")
    if not c_profile:
        return nodes.withColumn("experimental", none), edges.withColumn("experimental", none)
    parts = []
    for df, c, aliases, allowed, other in ((nodes, "group", GROUP_ALIASES, NODE_GROUPS, "external"), (edges, "kind", KIND_ALIASES, EDGE_KINDS, "pointer_flow")):
        name = canonical(F.col(c), aliases)
        known = name.isin(allowed)
        parts.append(df.withColumns({"experimental": F.when(known, none).otherwise(F.col(c)), c: F.when(known, name).otherwise(other)}))
    return parts[0], parts[1]


def hints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, call_edges_are_heuristic, large_graph_warning."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select(F.lit(0), F.lit(1)))
    counts = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))
    large = (F.col("node_count") > MANY_NODES) | (F.col("edge_count") > MANY_EDGES)
    return counts.select("node_count", "edge_count", F.lit(True).alias("call_edges_are_heuristic"), large.alias("large_graph_warning"))


def writes_state(entry_only: bool = False) -> Column:
    """Functions with state writes; entry points only where asked for."""
    found = (F.col("group") == "function") & (F.coalesce(F.size("state_writes"), F.lit(0)) > 0)
    return found & F.coalesce(F.col("is_entrypoint"), F.lit(False)) if entry_only else found


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among the nodes."""
    ids = nodes.select("id").distinct()
    out = edges
    for end in ("source", "target"):
        out = out.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return out.where("_source or _target").select(*edges.columns)


def badges(nodes: DataFrame, *keys: str) -> DataFrame:
    """How many nodes there are, how many write state, and how many of those are entry points."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("nodes"), F.count_if(writes_state()).alias("writers"), F.count_if(writes_state(True)).alias("entry_writers"))


def with_confidence(findings: DataFrame, wanted: str = "any") -> DataFrame:
    return findings if wanted == "any" else findings.where(F.col("confidence") == wanted)


def drift(declared: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which side lacks them."""
    a, b = (df.select(key).distinct().withColumn(name, F.lit(True)) for df, name in ((declared, "d"), (registered, "r")))
    both = a.join(b, key, "full_outer").where("d is null or r is null")
    return both.select(key, F.when(F.col("d").isNull(), "undeclared").otherwise("unregistered").alias("drift"))


def rings(functions: DataFrame) -> DataFrame:
    """Functions (id, parent, rings: names) as nested nodes: the first ring in the function's parent, each in the one before, the function in the last."""
    inner = lambda i: F.concat("id", F.lit("::ring::"), i.cast("string"))
    at = F.posexplode("rings").alias("i", "name")
    outer = functions.select("id", "parent", at).select(inner(F.col("i")).alias("id"), F.when(F.col("i") == 0, F.col("parent")).otherwise(inner(F.col("i") - 1)).alias("parent"), F.lit("modifier_ring").alias("group"), "name")
    own = functions.select("id", F.when(F.size("rings") > 0, inner(F.size("rings") - 1)).otherwise(F.col("parent")).alias("parent"), F.lit("function").alias("group"), F.lit("").alias("name"))
    return outer.unionByName(own)


def _fixed(n: Column, unit: int, digits: int) -> Column:
    """n / unit with so many digits after the point, halves upwards, in whole numbers only."""
    scale = 10**digits
    n = F.floor((n * (2 * scale) + unit) / (2 * unit)).cast("long")
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def format_size(c: Column) -> Column:
    return F.when(c < 1 << 10, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1 << 20, F.concat(_fixed(c, 1 << 10, 1), F.lit(" KB"))).otherwise(F.concat(_fixed(c, 1 << 20, 2), F.lit(" MB")))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(_fixed(ms, 1000, 2), F.lit(" s")))


def format_timestamp(iso: Column) -> Column:
    at = F.instr(iso, "T")
    cut = F.left(F.concat(F.left(iso, at - 1), F.lit(" "), F.substring(iso, at + 1, F.length(iso))), F.lit(19))
    return F.when(F.coalesce(iso, F.lit("")) == "", "-").when(at > 0, cut).otherwise(iso)


def export_name(filename: Column, scan_id: Column) -> Column:
    """A file name without its suffix, spelled with letters, digits, dots, _ and single dashes; else the scan's number."""
    name = F.regexp_replace(filename, r"\.[^.]+$", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9._-]+", "-"), "-+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("scan-"), scan_id.cast("string")))


def location(type_name: Column, function_name: Column, line_numbers: Column, line_number: Column) -> Column:
    """Where a finding is: its scope, its lines, both, or unknown."""
    scope = F.concat_ws(".", F.nullif(type_name, F.lit("")), F.nullif(function_name, F.lit("")))
    lines = F.when(F.size(line_numbers) > 0, F.array_join(line_numbers.cast("array<string>"), ", ")).otherwise(F.coalesce(line_number.cast("string"), F.lit("")))
    return F.when((scope != "") & (lines != ""), F.concat(scope, F.lit(" (lines: "), lines, F.lit(")"))).when(scope != "", scope).when(lines != "", F.concat(F.lit("lines: "), lines)).otherwise("unknown")
