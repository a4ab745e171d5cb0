"""Patterns of C, Graphviz text of any graph, and edges between the files of a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions import text as T

# Words before a parenthesis that are no calls.
NO_CALLS = ["if", "for", "while", "switch", "case", "do", "else", "return", "sizeof", "alignof", "offsetof", "typeof", "__typeof", "_Generic", "_Static_assert", "static_assert", "FD_LIKELY", "FD_UNLIKELY", "FD_TEST"]
STRUCT_HEAD = r"\bstruct\s+([A-Za-z_]\w*)\s*\{"
INCLUDE = r'#include\s+[<"]([^>"]+\.c)[>"]'


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line of Graphviz text for each node and edge."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("")), F.lit('"'))
    return nodes.select(F.concat(q(F.col("id")), F.lit(" [label="), q(F.col("label")), F.lit("];")).alias("line")).union(edges.select(F.concat(q(F.col("source")), F.lit(" -> "), q(F.col("target")), F.lit(" [label="), q(F.col("kind")), F.lit("];"))))


# How a file names another of its bundle, by language: pattern, suffixes of the file meant, kind of the edge.
IMPORTS = {
    "solidity": (r'(?m)^[ \t]*import\b[^;"\']*["\']([^"\']+\.sol)["\']', [""], "bundle_import"),
    "rust": (r"\bmod\s+(\w+)\s*;|\buse\s+(?:crate|super)::(\w+)", [".rs"], "bundle_import"),
    "c": (r'#include\s+[<"]([^>"]+\.[ch])[>"]', [""], "tile_to_tile"),
}


def imports(sources: DataFrame) -> DataFrame:
    """consumer, provider, kind: a file of a bundle that names another by its base name, whatever the case.

    An equality join on lower-cased base names; a file doesn't import itself, and each pair counts once.
    """
    base = F.lower(T.basename(F.col("path")))
    members = sources.select("language", base.alias("wanted"), F.col("path").alias("provider"))
    out = None
    for language, (pattern, suffixes, kind) in IMPORTS.items():
        content = F.regexp_replace("content", r"//[^\n]*", "") if language != "c" else F.col("content")
        named = F.filter(F.concat(F.regexp_extract_all(content, F.lit(pattern), 1), F.regexp_extract_all(content, F.lit(pattern), 2) if language == "rust" else F.array().cast("array<string>")), lambda x: x != "")
        files = sources.where(F.col("language") == language).select("language", F.col("path").alias("consumer"), F.explode(F.array_distinct(F.transform(named, lambda x: F.lower(T.basename(x))))).alias("name"))
        for suffix in suffixes:
            part = files.withColumn("wanted", F.concat("name", F.lit(suffix))).join(members, ["language", "wanted"]).where("consumer <> provider").select("consumer", "provider", F.lit(kind).alias("kind")).distinct()
            out = part if out is None else out.unionByName(part)
    return out


def bundle_edges(sources: DataFrame) -> DataFrame:
    """id, source, target, kind of imports, between types that are named after files."""
    anchor = lambda c: F.concat(F.lit("type:"), T.basename(F.col(c)))
    out = imports(sources).select(anchor("consumer").alias("source"), anchor("provider").alias("target"), "kind").distinct()
    return out.select(T.short_digest(F.concat_ws(">", "source", "kind", "target"), 12).alias("id"), "source", "target", "kind")
