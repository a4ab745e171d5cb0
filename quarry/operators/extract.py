"""Declarations read from unified Solidity text, and parameters, structures and fields of C functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quarry.functions.text import collapse
from quarry.sources.code import without_solidity_comments

#: What stands for a line's end in unified text, and names of types that ``name *`` doesn't make a structure.
LINE_END = "--.--"
PLAIN_TYPES = ["void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "size_t", "ssize_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t", "uintptr_t", "intptr_t", "bool", "_bool"]
IDENTIFIER = r"^[A-Za-z_]\w*$"


def unified_line(line: str) -> str | None:
    """A line up to its comment; none if it is one. What follows ``http:`` or ``https:`` is no comment."""
    if line.lstrip().startswith("//"):
        return None
    head, mark, _ = line.partition("//")
    return line if mark and head.endswith(("http:", "https:")) else head


@pandas_udf(StringType())
def unified(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each text as one line without comments; ends of lines show as marks. Null stays null."""
    for column in texts:
        kept = column.map(lambda t: f" {LINE_END}".join(x for x in map(unified_line, t.rstrip("\n").split("\n")) if x is not None), na_action="ignore")
        yield kept.map(lambda t: " ".join(without_solidity_comments(t).split()), na_action="ignore")


def imports(c: Column) -> Column:
    """What unified text imports: from a line that begins with the word, up to the semicolon."""
    found = F.regexp_extract_all(c, F.lit(rf"\Q{LINE_END}import\E([^;]*);"), 1)
    return F.transform(found, lambda x: F.trim(F.replace(F.replace(x, F.lit(LINE_END), F.lit("")), F.lit("import"), F.lit(""))))


def using(c: Column) -> Column:
    """The words of the first ``using`` of a contract, with its semicolon; empty without one."""
    found = F.regexp_extract(c, r"using[^;]*;", 0)
    return F.when(found != "", F.split(found, " ", -1)).otherwise(F.array().cast("array<string>"))


def events(c: Column) -> Column:
    """(name, params) of each event; params with both parentheses and the semicolon."""
    part = lambda k: F.regexp_extract_all(c, F.lit(r"event ([^(]*)(\([^;]*;)"), k)
    return F.zip_with(F.transform(part(F.lit(1)), lambda x: F.trim(F.replace(x, F.lit("event"), F.lit("")))), part(F.lit(2)), lambda n, p: F.struct(n.alias("name"), p.alias("params")))


def object_calls(body: Column, name: Column) -> Column:
    """The methods that a body calls on an object, each once."""
    return F.array_distinct(F.regexp_extract_all(body, F.concat(F.lit(r"(?<!_)\Q"), name, F.lit(r"\E\.([^(]*)\(")), 1))


def inputs(params: Column) -> Column:
    """The words of each parameter of C; none for ``void`` and ``...`` alone."""
    parts = F.filter(F.transform(F.split(params, ",", -1), collapse), lambda x: x != "")
    return F.when(F.trim(params).isin("", "void", "..."), F.array().cast("array<array<string>>")).otherwise(F.transform(parts, lambda x: F.split(x, " ", -1)))


def param_names(c: Column) -> Column:
    """The last word of each input if it is an identifier, else its number."""
    last = lambda x: F.get(x, F.size(x) - 1)
    return F.transform(c, lambda x, i: F.when(F.coalesce(last(x).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False)), last(x)).otherwise(F.concat(F.lit("arg"), i.cast("string"))))


def struct_bindings(c: Column, structs: Column) -> Column:
    """(param, struct) for each input whose type names a structure: the first by name."""
    names = F.array_sort(structs)

    def bound(x: Column) -> Column:
        line = F.array_join(x, " ")
        meant = lambda n: F.regexp_like(line, F.concat(F.lit(r"\bstruct\s+\Q"), n, F.lit(r"\E\b|\b\Q"), n, F.lit(r"\E\s*\*")))
        return F.struct(F.get(x, F.size(x) - 1).alias("param"), F.get(F.filter(names, meant), F.lit(0)).alias("struct"))

    return F.filter(F.transform(c, bound), lambda b: b["struct"].isNotNull() & b["param"].rlike(IDENTIFIER))


def field_hints(functions: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of bound parameters that a body reads or writes: keys, struct, field, via; the first parameter of each field.

    functions: keys, body, bindings. One pass over a body, then a lookup among its own bindings.
    """
    part = lambda k: F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\s*->\s*([A-Za-z_]\w*)\b"), F.lit(k))
    used = functions.select(*keys, "bindings", F.posexplode(F.arrays_zip(part(1).alias("via"), part(2).alias("field"))).alias("at", "u"))
    held = F.get(F.filter("bindings", lambda b: b["param"] == F.col("u.via")), F.lit(-1) + F.size(F.filter("bindings", lambda b: b["param"] == F.col("u.via"))))
    found = used.select(*keys, "at", "u.via", "u.field", held["struct"].alias("struct")).where("struct is not null")
    return found.groupBy(*keys, "struct", "field").agg(F.min_by("via", "at").alias("via"))


def typedef_structs(clean: Column, tags: Column) -> Column:
    """Aliases of ``typedef struct``, flat bodies only, in order of names; not those that are tags or plain types."""
    names = F.array_distinct(F.regexp_extract_all(clean, F.lit(r"\btypedef\s+struct\s*(?:[A-Za-z_]\w*)?\s*\{(?:[^{}]|\{[^{}]*\})*\}\s*([A-Za-z_]\w*)\s*;"), 1))
    return F.array_sort(F.filter(names, lambda n: ~F.array_contains(tags, n) & (F.length(n) > 1) & ~F.lower(n).isin(PLAIN_TYPES)))


def callsite_lines(lines: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the numbers of its lines that hold one of its callsites (site), ascending and each once."""
    found = lines.join(sites.where("site <> ''"), keys).where(F.contains(F.trim("line"), F.col("site")))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("n")).alias("line_numbers"))
