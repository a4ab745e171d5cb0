"""What each language brings to the graph payload: rows of payload.NODE and payload.EDGE from sources and kept facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import text as T
from quarry.operators import calls, code_graph, extract, payload, rust_rules, solidity_graph, solidity_rules
from quarry.operators.shared import Rounds, shuffled
from quarry.sources.facts import Facts

#: Orders inside a file: types, then functions, state, events and modifiers of each type.
_TYPE, _STATE, _EVENT, _MODIFIER = 1 << 24, 1 << 20, 2 << 20, 3 << 20
# Entities that stand for the ledger in contracts of Rust, with their kinds; what calls look like that are no names of functions.
LEDGER = (("LedgerInstancePartition", "ledger_instance"), ("LedgerPersistentPartition", "ledger_persistent"), ("LedgerTemporaryPartition", "ledger_temporary"), ("AuthLedgerCheck", "phantom_auth"), ("SorobanEventPublish", "event_sink"), ("external_invoke_target", "cross_contract_placeholder"))
RUST_NO_CALLS = ["pub", "fn", "let", "match", "self", "unsafe"]

_node = lambda df, **c: payload.rows(df, payload.NODE, **c)
_edge = lambda df, **c: payload.rows(df, payload.EDGE, **c)
_none = lambda: F.array().cast("array<string>")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbered(edges: list[DataFrame], family: int) -> DataFrame:
    """Edges of several families, whose places follow family, first name and place of the target."""
    return _union([e.withColumn("ord", F.lit((family + k) << 40) + F.col("ord")) for k, e in enumerate(edges)])


# --- Solidity -----------------------------------------------------------------------------------------------------------


def state_accesses(contracts: DataFrame) -> DataFrame:
    """path, type_name, fn_ord, fn_name, entity_name, access_kind, source_statement: each statement that names a state variable.

    With a = it writes all that it names, else it reads them; each once for a function. contracts: solidity_rules.contracts_of.
    """
    named = contracts.select("path", "type_name", "fn_ord", "fn_name", F.explode(F.array_distinct("stmts")).alias("source_statement"), "state")
    each = named.select("path", "type_name", "fn_ord", "fn_name", F.explode(F.array_distinct(F.filter("state", lambda v: F.contains(F.col("source_statement"), v)))).alias("entity_name"), "source_statement")
    return each.withColumn("access_kind", F.when(F.contains("source_statement", F.lit("=")), "write").otherwise("read"))


def guard_facts(contracts: DataFrame) -> DataFrame:
    """path, type_name, fn_ord, fn_name, ord, guard_type, expression, confidence_reason: conditions, then requires, then asserts."""
    kinds = (("conditionals", "conditional", "parsed_function_conditional"), ("requires", "require", "parsed_require_statement"), ("asserts", "assert", "parsed_assert_statement"))
    told = lambda kind, reason: lambda x: F.struct(F.lit(kind).alias("guard_type"), x.alias("expression"), F.lit(reason).alias("confidence_reason"))
    facts = F.concat(*[F.transform(c, told(kind, reason)) for c, kind, reason in kinds])
    return contracts.select("path", "type_name", "fn_ord", "fn_name", F.posexplode(facts).alias("ord", "g")).select("path", "type_name", "fn_ord", "fn_name", "ord", "g.*")


def modifiers_of(contracts: DataFrame) -> Column:
    """The modifiers in a function's head."""
    words = F.split(F.regexp_replace("modifiers", r"\([^)]*\)", " "), r"[\s,]+", -1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(solidity_graph.NO_MODIFIERS) & w.rlike(r"^[A-Za-z_]\w*$")))


def solidity(sources: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    df = solidity_rules.contracts_of(contracts)
    own = Rounds(sources.sparkSession, "own-texts").save(solidity_graph.own_texts(sources, contracts))
    types = own.select("path", "type_name", "at")
    df = df.join(shuffled(types), ["path", "type_name"]).withColumn("used", modifiers_of(df))
    base = F.col("at") * _TYPE
    reads = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("stmts", lambda s: ~F.contains(s, F.lit("="))), lambda s: F.filter("state", lambda v: F.contains(s, v))))))
    entry = F.col("modifiers").rlike(r"\b(?:external|public)\b")
    nodes = [_node(types, language="solidity", ord=F.col("at") * _TYPE, group="type", label=F.col("type_name"), kind="contract_like")]
    nodes.append(_node(df, language="solidity", ord=base + 1 + F.col("fn_ord"), group="function", label=F.col("fn_name"), is_entrypoint=entry, state_reads=reads, state_writes=F.col("mutations"), guards=F.array_distinct(F.filter(F.transform("guards", lambda g: F.trim(g)), lambda g: g != "")), modifiers=F.col("used")))
    state = df.select("path", "type_name", "at", F.posexplode(F.array_union("state", "objects")).alias("k", "name")).distinct()
    nodes.append(_node(state, language="solidity", ord=base + _STATE + F.col("k"), group="state", label=F.col("name"), kind="state_variable"))
    events = solidity_graph.events_of(own)
    nodes.append(_node(events, language="solidity", ord=base + _EVENT + F.col("k"), group="event", label=F.col("name")))
    declared = own.select("path", "type_name", "at", F.explode(F.array_distinct(F.regexp_extract_all("own", F.lit(r"\bmodifier\s+(\w+)"), 1))).alias("name"), F.lit("declared").alias("origin"))
    used = df.select("path", "type_name", "at", F.explode("used").alias("name"), F.lit("inherited_or_external").alias("origin"))
    each = declared.unionByName(used).groupBy("path", "type_name", "at", "name").agg(F.min("origin").alias("kind"))
    nodes.append(_node(each, language="solidity", ord=base + _MODIFIER, group="modifier", label=F.col("name")))
    # edges by names, with the arguments of calls between functions of a contract
    links = solidity_graph.edges(contracts, events).where("kind <> 'function_to_object'").withColumn("label", F.lit(""))
    links = links.unionByName(solidity_graph.object_edges(contracts))
    params = contracts.select("path", "type_name", "fn_name", "body", "state", extract.param_names(extract.inputs(F.col("params"))).alias("names"))
    caller = params.select("path", F.col("type_name").alias("source_type"), F.col("fn_name").alias("source_name"), "body", "state", F.col("names").alias("caller_params")).dropDuplicates(["path", "source_type", "source_name"])
    callee = params.select("path", F.col("type_name").alias("target_type"), F.col("fn_name").alias("bare"), F.col("names").alias("callee_params")).dropDuplicates(["path", "target_type", "bare"])
    inner = links.where("kind = 'function_to_function'").withColumn("bare", F.regexp_replace("target_name", r"^super\.", ""))
    inner = inner.join(shuffled(caller), ["path", "source_type", "source_name"], "left").join(shuffled(callee), ["path", "target_type", "bare"], "left")
    site = call_site(F.col("body"), F.col("bare"))
    args = F.when(site != "", calls.positional_args(F.regexp_extract(site, r"(?s)^[^(]*\((.*)\)$", 1), F.coalesce("callee_params", _none()), F.coalesce("caller_params", _none()), F.coalesce("state", _none())))
    inner = inner.select(*links.columns, "bare", site.alias("callsite"), args.alias("args_map"))
    order = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 39))
    place = order("source_type", "source_name", "target_type", "target_name", "kind", "label")
    plain = _edge(links.where("kind <> 'function_to_function'"), ord=place)
    told = _edge(inner.withColumn("target_name", F.col("bare")), ord=place)
    return _union(nodes), plain.unionByName(told)


def call_site(body: Column, name: Column) -> Column:
    """The first call of a name in a body, up to the parenthesis that closes it; empty without one."""
    start = F.regexp_instr(body, F.concat(F.lit(r"\b(?:super\.)?\Q"), name, F.lit(r"\E\s*\(")))
    rest = F.substring(body, start, F.lit(1 << 30))
    return F.when(start > 0, T.balanced(rest)).otherwise("")


# --- C ------------------------------------------------------------------------------------------------------------------


def c(sources: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = sources.where("language = 'c'").select("path", payload_stem().alias("type_name"), "content")
    code = functions.where("language = 'c'")
    clean = F.regexp_replace("content", r"(?s)/\*.*?\*/|//[^\n]*", " ")
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(clean, F.lit(code_graph.STRUCT_HEAD), 1)))
    aliases = extract.typedef_structs(clean, tags)
    known = files.select("path", "type_name", tags.alias("tags"), aliases.alias("aliases"), F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(code_graph.INCLUDE), 1), lambda p: F.replace(F.trim(p), F.lit("\\"), F.lit("/")))).alias("paths"))
    # of several paths with one base name the first has the plain name
    base = lambda p: T.basename(p)
    included = F.transform("paths", lambda p, i: F.concat(F.lit("inc:"), base(p), F.when(F.exists(F.slice("paths", F.lit(1), i), lambda q: base(q) == base(p)), F.concat(F.lit("~"), F.left(F.sha2(p, 256), F.lit(8)))).otherwise("")))
    known = known.withColumn("included", F.array_sort(included))
    calls_in_order = F.filter(F.transform(T.statements(F.col("body")), lambda s: F.regexp_extract(s, r"\b([A-Za-z_]\w*)\s*\(", 1)), lambda x: (x != "") & ~x.isin(code_graph.NO_CALLS))
    nodes = [_node(files, language="c", ord=F.lit(0), group="type", label=F.col("type_name"), kind="translation_unit")]
    nodes.append(_node(code, language="c", ord=1 + F.col("fn_ord"), group="function", label=F.col("fn_name"), is_entrypoint=F.col("visibility") == "external", callees=calls_in_order))
    for k, (column, kind) in enumerate((("tags", "struct"), ("aliases", "typedef_struct"), ("included", "include_template"))):
        entity = known.select("path", "type_name", F.posexplode(column).alias("at", "name"))
        nodes.append(_node(entity, language="c", ord=_STATE * (k + 1) + F.col("at"), group="state", label=F.col("name"), kind=kind))
    first = F.col("fn_ord").cast("long") * (1 << 16)
    called = code.select("path", "type_name", "fn_name", "fn_ord", F.posexplode(T.call_tokens(F.col("body"), code_graph.NO_CALLS)).alias("at", "name")).where("name <> fn_name")
    kind = F.when(F.col("name").rlike("^(?:SYS_|__NR_)|(?i:syscall)"), "function_to_syscall").otherwise("function_to_function")
    edges = [_edge(called, ord=first + F.col("at"), source_type=F.col("type_name"), source_name=F.col("fn_name"), target_type=F.col("type_name"), target_name=F.col("name"), kind=kind, label="c_call_heuristic")]
    names = F.array_union("tags", "aliases")
    text = F.regexp_replace(F.concat_ws("\n", "params", "body"), r"\s+", " ")
    meant = lambda n: F.regexp_like(F.col("text"), F.concat(F.lit(r"\bstruct\s+\Q"), n, F.lit(r"\E\b|\b\Q"), n, F.lit(r"\E\s*\*")))
    used = code.select("path", "type_name", "fn_name", "fn_ord", text.alias("text")).join(shuffled(known.select("path", names.alias("names")).where(F.size("names") > 0)), "path")
    used = used.select("path", "type_name", "fn_name", "fn_ord", F.posexplode(F.filter("names", meant)).alias("at", "name"))
    edges.append(_edge(used, ord=first + F.col("at"), source_type=F.col("type_name"), source_name=F.col("fn_name"), target_type=F.col("type_name"), target_name=F.col("name"), kind="function_to_workspace", label="struct_use_heuristic"))
    units = known.select("path", "type_name", F.posexplode("included").alias("at", "name"))
    edges.append(_edge(units, ord=F.col("at"), source_type=F.col("type_name"), source_name=payload.INCLUDER, target_type=F.col("type_name"), target_name=F.col("name"), kind="function_to_include_template", label="translation_unit_include"))
    return _union(nodes), _numbered(edges, 0)


def payload_stem() -> Column:
    return F.regexp_replace(T.basename(F.col("path")), r"(?s)^(.+)\.[^.]*$", "$1")


# --- Rust ---------------------------------------------------------------------------------------------------------------


def rust(sources: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = sources.where("language = 'rust'").select("path", payload_stem().alias("type_name"))
    facts = rust_rules.with_facts(functions, sources)
    nodes = [_node(files, language="rust", ord=F.lit(0), group="type", label=F.col("type_name"), kind="soroban_contract")]
    nodes.append(_node(facts, language="rust", ord=1 + F.col("fn_ord"), group="function", label=F.col("fn_name"), is_entrypoint=F.col("contract") & F.col("visibility").isin("external", "crate")))
    ledger = files.select("path", "type_name", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("what")) for n, k in LEDGER])).alias("at", "e"))
    nodes.append(_node(ledger, language="rust", ord=_STATE + F.col("at"), group="state", label=F.col("e.name"), kind=F.col("e.what")))
    tight = F.replace(F.col("u"), F.lit(" "), F.lit(""))
    target = lambda name, kind, label, when: F.when(when, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), (F.lit(label) if isinstance(label, str) else label).alias("label")))
    out = F.array(
        target("LedgerInstancePartition", "function_to_object", "storage_instance_write", F.col("instance")),
        target("LedgerPersistentPartition", "function_to_object", "storage_persistent_write", F.col("persistent")),
        target("LedgerTemporaryPartition", "function_to_object", "storage_temporary_write", F.col("temporary")),
        target("external_invoke_target", "function_to_object", F.when(F.col("plain_call"), "invoke_contract").otherwise("try_invoke_contract"), F.col("plain_call") | F.col("tried")),
        target("SorobanEventPublish", "function_to_event", "events_publish", F.contains(tight, F.lit("events()")) & F.contains(F.col("u"), F.lit(".publish("))),
        target("AuthLedgerCheck", "state_to_function", "require_auth_fact", F.col("auth")),
    )
    first = F.col("fn_ord").cast("long") * (1 << 16)
    held = facts.select("path", "type_name", "fn_name", "fn_ord", F.posexplode(F.filter(out, lambda x: x.isNotNull())).alias("at", "e"))
    auth = F.col("e.kind") == "state_to_function"
    edges = [_edge(held, ord=first + F.col("at"), source_type=F.col("type_name"), source_name=F.when(auth, F.col("e.name")).otherwise(F.col("fn_name")), target_type=F.col("type_name"), target_name=F.when(auth, F.col("fn_name")).otherwise(F.col("e.name")), kind=F.col("e.kind"), label=F.col("e.label"), callsite=F.when(auth, "auth_dep").otherwise(""))]
    # every call of a function of the file, again where it is called again
    called = facts.select("path", "type_name", "fn_name", "fn_ord", F.posexplode(F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), 1)).alias("at", "name")).where("name <> fn_name")
    called = called.join(shuffled(functions.where("language = 'rust'").select("path", F.col("fn_name").alias("name")).distinct()), ["path", "name"], "left_semi").where(~F.col("name").isin(RUST_NO_CALLS))
    edges.append(_edge(called, ord=first + F.col("at"), source_type=F.col("type_name"), source_name=F.col("fn_name"), target_type=F.col("type_name"), target_name=F.col("name"), kind="function_to_function", label="intracontract_call"))
    return _union(nodes), _numbered(edges, 8)


def model(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of payload.NODE and payload.EDGE of all files of sources."""
    kept, spark = Facts(sources.sparkSession), sources.sparkSession
    # many joins read them: found once, by files
    functions, contracts = Rounds(spark, "functions").save(kept.functions(sources)), Rounds(spark, "contracts").save(kept.contracts(sources))
    parts = [solidity(sources.where("language = 'solidity'"), contracts), c(sources, functions), rust(sources, functions)]
    return _union([n for n, _ in parts]), _union([e for _, e in parts])
