"""Edges of Solidity code by names: who reads, calls or emits what.

Candidates meet the bodies of their own contract (or of a contract that inherits from it or names it as an interface) in
equality joins on path and contract; names are then looked for in the body. Edges run from the caller to what it calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators import extract
from quarry.operators.shared import shuffled

# Functions of the system, looked for by name.
SYSTEM = [
    "Transfer", "Approval", "revert", "assert", "abi.decode",
    "abi.encode", "abi.encodeWithSelector", "abi.encodeWithSignature",
    "abi.encodePacked", "abi.encodeCall",
    "data.writeUint32LE", "data.writeUint64LE", "readInt8", "readInt16LE",
    "writeString", "writeAddress", "writeUint256LE", "writeUint64LE",
    "writeInt256LE", "readAddress", "writeInt8", "writeInt32LE",
    "addmod", "mulmod", ".s_feeManager", ".verify",
]
#: Words of a function's head that are no modifiers.
NO_MODIFIERS = ["", "public", "external", "internal", "private", "view", "pure", "payable", "virtual", "override", "returns", "memory", "calldata", "storage"]

EDGE = ("path", "source_type", "source_name", "target_type", "target_name", "kind")


def touches(body: Column, name: Column) -> Column:
    """A variable in a body: not after an underscore, and before a space, =, [ or ;."""
    return F.regexp_like(body, F.concat(F.lit(r"(?<!_)\Q"), name, F.lit(r"\E[ =\[;]")))


def calls_of(body: Column, name: Column) -> Column:
    """``name(`` in a body that doesn't have the name after an underscore anywhere."""
    return F.contains(body, F.concat(name, F.lit("("))) & ~F.contains(body, F.concat(F.lit("_"), name))


def own_texts(sources: DataFrame, contracts: DataFrame) -> DataFrame:
    """path, type_name, at, own: each type's place in its file and its text, which reaches to the next type."""
    texts = sources.where("language = 'solidity'").select("path", "content")
    named = contracts.select("path", "type_name").distinct().join(shuffled(texts), "path")
    at = F.greatest(*[F.regexp_instr("content", F.concat(F.lit(rf"\b{word}\s+"), F.col("type_name"), F.lit(r"\b"))) for word in ("contract", "library", "interface")])
    spans = named.select("path", "type_name", at.cast("long").alias("at"), "content")
    # the types of a file are few: their places meet in one row
    places = spans.groupBy("path").agg(F.array_sort(F.collect_set("at")).alias("places"))
    following = F.get(F.filter("places", lambda x: x > F.col("at")), F.lit(0))
    end = F.coalesce(following, F.length("content") + 1)
    return spans.join(shuffled(places), "path").select("path", "type_name", "at", F.substring("content", F.col("at").cast("int"), (end - F.col("at")).cast("int")).alias("own"))


def events_of(own: DataFrame) -> DataFrame:
    """path, type_name, at, k, name of the events that each type declares, in their order."""
    found = F.array_distinct(F.regexp_extract_all("own", F.lit(r"\bevent\s+(\w+)\s*\("), 1))
    return own.select("path", "type_name", "at", F.posexplode(found).alias("k", "name"))


def object_edges(contracts: DataFrame) -> DataFrame:
    """The columns EDGE and label: each function with the objects of its contract on which it calls the method label."""
    c = F.col
    called = contracts.select("path", "type_name", "fn_name", "body", F.explode(F.array_distinct("objects")).alias("name"))
    called = called.select("path", "type_name", "fn_name", "name", F.explode(extract.object_calls(c("body"), c("name"))).alias("label"))
    return called.select("path", c("type_name").alias("source_type"), c("fn_name").alias("source_name"), c("type_name").alias("target_type"), c("name").alias("target_name"), F.lit("function_to_object").alias("kind"), "label").distinct()


def edges(contracts: DataFrame, events: DataFrame) -> DataFrame:
    """The columns EDGE for contracts (path, type_name, parents, interfaces, objects, state, fn_ord, fn_name, body) and events_of; no edge twice."""
    c = F.col
    of = contracts.select("path", "type_name", F.array_union("parents", "interfaces").alias("owners"), "state", "fn_name", "body")
    body = of.select("path", "type_name", "owners", c("fn_name").alias("caller"), "body")
    state = of.select("path", c("type_name").alias("owner"), F.explode("state").alias("name")).distinct()
    named = of.select("path", c("type_name").alias("owner"), c("fn_name").alias("name")).distinct()
    row = lambda df, *cols: df.select("path", *[x.alias(n) for x, n in zip(cols, EDGE[1:])])
    own = lambda names: body.join(shuffled(names), (body.path == names.path) & (body.type_name == names.owner)).drop(names.path)
    heirs = body.select("path", "type_name", "caller", "body", F.explode("owners").alias("owner"))
    reads = row(own(state).where(touches(c("body"), c("name"))), c("owner"), c("name"), c("type_name"), c("caller"), F.lit("state_to_function"))
    target = F.when(c("caller") == c("name"), F.concat(F.lit("super."), "name")).otherwise(c("name"))
    inner = row(own(named).where(calls_of(c("body"), c("name"))), c("type_name"), c("caller"), c("owner"), target, F.lit("function_to_function"))
    system = body.select("*", F.explode(F.filter(F.array(*[F.lit(x) for x in SYSTEM]), lambda x: calls_of(c("body"), x))).alias("name"))
    system = row(system, c("type_name"), c("caller"), F.lit(""), c("name"), F.lit("function_to_system"))
    emitted = body.select("*", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\bemit\s+(\w+)\s*\("), 1))).alias("name")).join(shuffled(events), ["path", "type_name", "name"], "left_semi")
    emitted = row(emitted, c("type_name"), c("caller"), c("type_name"), c("name"), F.lit("function_to_event"))
    past = row(heirs.join(shuffled(state), ["path", "owner"]).where(touches(c("body"), c("name"))), c("owner"), c("name"), c("type_name"), c("caller"), F.lit("cross_type_state"))
    above = row(heirs.join(shuffled(named), ["path", "owner"]).where(calls_of(c("body"), c("name"))), c("type_name"), c("caller"), c("owner"), c("name"), F.lit("cross_type_call"))
    out = reads
    for part in (inner, system, emitted, past, above, object_edges(contracts).select(*EDGE)):
        out = out.unionByName(part)
    return out.distinct()
