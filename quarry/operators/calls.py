"""Arguments of calls, paths of writes, parents without cycles, endpoints of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators.shared import Rounds, shuffled

#: How a literal begins, besides quotes, digits and 0x.
LITERAL = r"""^(?:true|false|['"].*|\d+|0x[0-9a-fA-F]+|(?:address\(|uint|int|bytes|string\().*)$"""
LOCAL = r"^[A-Za-z_][A-Za-z0-9_]*(?:\[[^\]]+\])?$"


def split_arguments(c: Column) -> Column:
    """The arguments of a call's inner text: parts between commas outside of brackets of three kinds, trimmed, none empty."""
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(0).alias("b"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, ch: Column) -> Column:
        cut = (ch == ",") & (a.p == 0) & (a.s == 0) & (a.b == 0)
        depth = lambda d, pair: F.when(ch == pair[0], d + 1).when(ch == pair[1], F.greatest(d - 1, F.lit(0))).otherwise(d)
        return F.struct(depth(a.p, "()").alias("p"), depth(a.s, "[]").alias("s"), depth(a.b, "{}").alias("b"), F.when(cut, "").otherwise(F.concat(a.now, ch)).alias("now"), F.when(cut, F.array_append(a.done, a.now)).otherwise(a.done).alias("done"))

    parts = F.aggregate(F.split(c, ""), zero, step, lambda a: F.array_append(a.done, a.now))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _names(value: Column, names: Column) -> Column:
    """Whether one of the names stands in the value as a whole word."""
    return F.exists(names, lambda n: (n != "") & F.regexp_like(value, F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))))


def source_kind(value: Column, params: Column, state: Column) -> Column:
    """Where an argument comes from: literal, input, state, local or unknown."""
    return F.when(value == "", "unknown").when(value.rlike(LITERAL), "literal").when(_names(value, params), "input").when(_names(value, state), "state").when(value.rlike(LOCAL), "local").otherwise("unknown")


def positional_args(args: Column, callee_params: Column, caller_params: Column, state: Column) -> Column:
    """An array of (param, value, source_kind): the i-th argument goes to the callee's i-th parameter, or to ``arg<i>``."""
    name = lambda i: F.coalesce(F.get(callee_params, i), F.concat(F.lit("arg"), i.cast("string")))
    return F.transform(split_arguments(args), lambda v, i: F.struct(name(i).alias("param"), v.alias("value"), source_kind(v, caller_params, state).alias("source_kind")))


def write_paths(functions: DataFrame, edges: DataFrame, own: int = 3, args: int = 3) -> DataFrame:
    """Per function (id, label, writes: array) the ways it writes state, in order and without repeats: path, confidence.

    Its own first writes, then the first write of each function it calls (edges: source, target, ord, args_map), by each of
    the first arguments or, without any, as a whole.
    """
    mine = functions.select("id", F.lit(-1).cast("long").alias("ord"), F.posexplode(F.slice("writes", 1, own)).alias("at", "w")).select("id", "ord", "at", F.concat(F.lit("self -> "), "w").alias("path"), F.lit("high").alias("confidence"))
    callee = functions.where(F.trim(F.get("writes", F.lit(0))) != "").select(F.col("id").alias("target"), "label", F.trim(F.get("writes", F.lit(0))).alias("first"))
    called = edges.where("kind = 'function_to_function'").select(F.col("source").alias("id"), "target", F.col("ord").cast("long").alias("ord"), "args_map").join(shuffled(callee), "target")
    called = called.join(shuffled(functions.select("id")), "id", "left_semi")
    whole = F.array(F.concat(F.lit("internal call -> "), "label", F.lit(" -> "), "first"))
    blank = lambda c, d: F.when(F.trim(c) == "", d).otherwise(F.coalesce(F.trim(c), F.lit(d)))
    each = F.transform(F.slice("args_map", 1, args), lambda a: F.concat(blank(a.param, "arg"), F.lit(" <- "), blank(a.value, "?"), F.lit(" ("), blank(a.source_kind, "unknown"), F.lit(") -> "), F.col("label"), F.lit(" -> "), F.col("first")))
    heard = called.select("id", "ord", F.posexplode(F.when(F.size("args_map") > 0, each).otherwise(whole)).alias("at", "path")).select("id", "ord", "at", "path", F.lit("heuristic").alias("confidence"))
    first = mine.unionByName(heard).groupBy("id", "path").agg(F.min(F.struct("ord", "at", "confidence")).alias("f"))
    return first.select("id", "path", F.col("f.confidence").alias("confidence"), F.col("f.ord").alias("ord"), F.col("f.at").alias("at"))


def drop_parent_cycles(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, ord) with ``kept``: the parent, or null where keeping it would leave a chain that returns to itself.

    Nodes lose their parents one by one in their order, so a node keeps its own if an earlier one of its chain loses its.
    Hence a node loses it if its chain returns and no node of the chain comes before it. Pointer doubling finds the least
    order on each chain in as many rounds as a chain's length has bits; every round is written, so plans stay small.
    """
    lost = losing_parents(nodes)
    if lost is None:
        return nodes.select("id", "parent", "ord", F.nullif("parent", F.lit("")).alias("kept"))
    lost = lost.select("id", F.lit(True).alias("lost"))
    return nodes.join(shuffled(lost), "id", "left").select("id", "parent", "ord", F.when(F.col("lost").isNull(), F.nullif("parent", F.lit(""))).alias("kept"))


def losing_parents(nodes: DataFrame) -> DataFrame | None:
    """The nodes (id) that drop_parent_cycles takes the parent from; none if no node's parent has a parent."""
    nested = nodes.where("parent <> ''").select("id", F.col("parent").alias("up"), F.col("ord").cast("long").alias("ord"))
    rounds = Rounds(nodes.sparkSession, "parent-cycles")
    # a parent that is no node or has none ends a chain; chains that ended go
    state = rounds.save(nested.join(shuffled(nested.select(F.col("id").alias("up"), F.col("ord").alias("low"))), "up").select("id", "ord", "up", "low"))
    n = state.count()
    for _ in range(n.bit_length()):
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"))
        state = rounds.save(state.join(shuffled(far), "up").select("id", "ord", F.col("next").alias("up"), F.least("low", "next_low").alias("low")))
        if not state.limit(1).count():
            return None
    return state.where("ord <= low").select("id") if n else None


#: Groups in the order in which a name is looked up, inside its type first and then anywhere.
GROUPS = ("function", "state", "event", "modifier")


def external_class(kind: Column, name: Column) -> Column:
    """What an unresolved name of C is likely to be, by its spelling. Prefixes and marks."""
    low = F.lower(name)
    starts = lambda c, *p: F.regexp_like(c, F.lit("^(?:" + "|".join(p) + ")"))
    holds = lambda c, *p: F.exists(F.array(*[F.lit(x) for x in p]), lambda x: F.contains(c, x))
    return (
        F.when(kind.isin("function_to_syscall", "function_to_system") | F.contains(low, F.lit("syscall")) | starts(name, "SYS_", "__NR_"), "unresolved_syscall")
        .when(starts(name, "fd_") | starts(low, "pthread_", "epoll_", "ioctl_") | (low == "ioctl"), "unresolved_lib")
        .when(holds(low, "->", "(*", "fnptr", "callback"), "unresolved_fnptr")
        .when(holds(name, "::", "."), "unresolved_lib")
        .otherwise("unresolved_symbol")
    )


def resolve_endpoints(edges: DataFrame, nodes: DataFrame, classed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (ord, kind, source_type, source_name, target_type, target_name) with ids of their ends, and the external nodes these need.

    nodes: id, group, type_name, label, ord. A name is looked up in its type by group, then in all types (the first node by
    group and order); names that nothing has become external nodes. Blank names drop their edge.
    """
    prio = F.lit(len(GROUPS))
    for k, g in reversed(list(enumerate(GROUPS))):
        prio = F.when(F.col("group") == g, k).otherwise(prio)
    nodes = nodes.where(F.col("group").isin(*GROUPS)).withColumn("prio", prio)
    inside = nodes.groupBy("type_name", "label").agg(F.min_by("id", F.struct("prio", "ord", "id")).alias("inside"))
    anywhere = nodes.groupBy("label").agg(F.min_by("id", F.struct("prio", "ord", "id")).alias("anywhere"))
    out = edges.where((F.coalesce("source_name", F.lit("")) != "") & (F.coalesce("target_name", F.lit("")) != ""))
    for end in ("source", "target"):
        t, n = f"{end}_type", f"{end}_name"
        own = inside.select(F.col("type_name").alias(t), F.col("label").alias(n), F.col("inside").alias("_i"))
        any_ = anywhere.select(F.col("label").alias(n), F.col("anywhere").alias("_a"))
        missing = F.concat(F.lit("external:"), F.concat(external_class(F.col("kind"), F.trim(n)), F.lit(":"), F.trim(n)) if classed else F.col(n))
        out = out.join(own, [t, n], "left").join(any_, n, "left").withColumn(end, F.coalesce("_i", "_a", missing)).drop("_i", "_a")
    ends = out.select(F.col("source").alias("id"), F.col("source_name").alias("label")).union(out.select("target", "target_name"))
    externals = ends.where(F.startswith("id", F.lit("external:"))).groupBy("id").agg(F.min("label").alias("label")).select("id", F.lit("external").alias("group"), "label")
    return out.select("ord", "source", "target", "kind"), externals
