"""Queries over models that every supplier has a copy of, marked with its key, each with SQL over the same rows or worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import adapters, calls, evidence, payload, solidity_graph, solidity_rules
from quarry.sources import code
from quarry.sources.facts import Facts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(literal, v)) + "]" if isinstance(v, list) else str(v)


def values(rows: list[tuple], name: str, columns: str) -> str:
    """The rows as a relation of SQL."""
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def spread(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str, **changes: str) -> DataFrame:
    """The rows once for each supplier, with its key as k; changes: by column what it becomes, in SQL of both engines."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    copies = F.explode(F.from_json(F.lit(text), f"array<struct<{schema}>>")).alias("r")
    out = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), copies).select("k", "r.*")
    return out.select("k", *[F.expr(changes.get(c, c)).alias(c) for c in names])


def spread_sql(rows: list[tuple], name: str, columns: str, **changes: str) -> str:
    """The same as a relation of SQL."""
    shown = ", ".join(f"{changes[c]} as {c}" if c in changes else c for c in columns.split(", "))
    return f"{values(rows, name + '_', columns)}, {name} as (select k, {shown} from {name}_, (select s_suppkey as k from supplier))"


# --- evidence ---------------------------------------------------------------------------------------------------------

MESSAGES = [
    (1, "a.sol", "Vault.take moves funds, line: total = total - x"),
    (2, "a.sol", "the statement 'paid[who] = 0' comes late in 'Vault.give'"),
    (3, "a.sol", "give is open"),
    (4, "a.sol", "Vault and Base are old"),
    (5, "a.sol", "nothing is named; 'no such statement'"),
    (6, "b.sol", "Vault.take is another file's"),
    (7, "a.sol", "paid[who] = 0; in Base.init"),
    (8, "a.sol", "line: "),
]
INDEX = [("a.sol", 0, "Base", "init", 0, "owner = who", None), ("a.sol", 1, "Vault", "take", 0, "total = total - x", "guard"), ("a.sol", 1, "Vault", "take", 1, "paid[who] = 0", None), ("a.sol", 2, "Vault", "give", 0, "", None)]
NAMES = [("a.sol", 0, "Base", 0, "init"), ("a.sol", 1, "Vault", 0, "take"), ("a.sol", 1, "Vault", 1, "give"), ("b.sol", 0, "Other", 0, "run")]
_ID, _AT = "k * 100 + alert_id", "concat(k, '/', path)"
LINES = [("a.sol", 3, "  total = total - x;"), ("a.sol", 4, "paid[who] = 0;"), ("a.sol", 9, "if (a) { paid[who] = 0; }"), ("b.sol", 1, "total = total - x;")]


@query(f"""with {spread_sql(MESSAGES, 'a', 'alert_id, path, message', alert_id=_ID, path=_AT)}, {spread_sql(INDEX, 'i', 'path, key_ord, t, f, ord, stmt, reason', path=_AT)}, {spread_sql(NAMES, 'n', 'path, type_ord, t, fn_ord, f', path=_AT)}, {spread_sql(LINES, 'l', 'path, n, line', path=_AT)},
c as (select alert_id, 0 as r0, key_ord as r1, 0 as r2, ord as r3, t, f, stmt, coalesce(reason, 'matched_statement_from_normalized_model') as reason from a join i using (path) where stmt <> '' and contains(message, stmt)
  union all select alert_id, 0, key_ord, 1, 0, t, f, null, 'matched_qualified_function_name' from a join (select distinct path, key_ord, t, f from i) using (path) where contains(message, t || '.' || f)
  union all select alert_id, 1, type_ord, fn_ord, 0, t, f, null, 'matched_function_name' from a join n using (path) where contains(message, f)
  union all select alert_id, 2, -type_ord, 0, 0, t, '', null, 'matched_type_name' from a join n using (path) where contains(message, t)),
b as (select * from c qualify row_number() over (partition by alert_id order by r0, r1, r2, r3) = 1),
s as (select a.alert_id, a.path, coalesce(t, '') as type_name, coalesce(f, '') as function_name, coalesce(reason, 'message_only_fallback') as confidence_reason,
  coalesce(stmt, case when contains(message, 'line:') then trim(substr(message, instr(message, 'line:') + 5)) else coalesce(regexp_extract_all(message, '''([^'']+)''', 1)[-1], '') end) as statement from a left join b using (alert_id))
select alert_id::bigint as alert_id, type_name, function_name, statement, confidence_reason, coalesce((select string_agg(l.n, ',' order by l.n) from l where l.path = s.path and s.statement <> '' and contains(l.line, s.statement)), '') as line_numbers from s""")
def evidence_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = lambda rows, schema, **changes: spread(spark, sf_dir, rows, schema, path=_AT, **changes).drop("k")
    alerts = copies(MESSAGES, "alert_id long, path string, message string", alert_id=_ID)
    index = copies(INDEX, "path string, key_ord int, type_name string, function_name string, ord int, source_statement string, reason string")
    names = copies(NAMES, "path string, type_ord int, type_name string, fn_ord int, fn_name string")
    out = evidence.infer(alerts, index, names, copies(LINES, "path string, n int, line string"))
    return out.select("alert_id", "type_name", "function_name", "statement", "confidence_reason", F.array_join(F.col("line_numbers").cast("array<string>"), ",").alias("line_numbers"))


@query("select role as code, trim(replace(coalesce(text, ''), chr(10), ' ')) as message, min(conv_id * 1000 + turn)::bigint as at from conversations group by all")
def merged_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("role").alias("code"), F.coalesce("text", F.lit("")).alias("message"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return evidence.merge_alerts(rows, ["at"])


# --- parents, arguments, paths of writes, endpoints --------------------------------------------------------------------


@query("""with recursive n as (select s_suppkey as id, (s_suppkey * s_suppkey + s_nationkey) % (select count(*) + 3 from supplier) as parent from supplier),
w as (select id as start, parent as cur, [id] as seen from n union all select start, n.parent, list_append(seen, cur) from w join n on n.id = w.cur where not list_contains(seen, cur)),
e as (select start, max(len(seen)) as longest, bool_or(list_contains(seen, cur)) as returns from w group by start),
f as (select e.start, returns, coalesce(list_min(seen[2:]), e.start) as low from e join w on w.start = e.start and len(w.seen) = longest)
select id, case when not (returns and id <= low) then parent end as kept from n join f on f.start = n.id""")
def parent_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    parent = F.col("s_suppkey") * F.col("s_suppkey") + F.col("s_nationkey")
    nodes = s.crossJoin(F.broadcast(s.agg((F.count("*") + 3).alias("n")))).select(F.col("s_suppkey").cast("string").alias("id"), (parent % F.col("n")).cast("string").alias("parent"), F.col("s_suppkey").alias("ord"))
    return calls.drop_parent_cycles(nodes).select(F.col("id").cast("long").alias("id"), F.col("kept").cast("long").alias("kept"))


CALLS = [
    ("pay", "to, amounts[i], f(a, b), {x, y}, 7", ["who", "sum"], ["to", "a"], ["amounts", "total"]),
    ("set", "true,'a,b', total + 1, 0x1F", ["p"], ["q"], ["total"]),
    ("one", " local[2] , address(this) ,, x.y ", [], ["local2"], []),
    ("none", "", ["p"], [], []),
]
ARGUMENTS = [
    ("pay", 0, "who", "to", "input"), ("pay", 1, "sum", "amounts[i]", "state"), ("pay", 2, "arg2", "f(a, b)", "input"), ("pay", 3, "arg3", "{x, y}", "unknown"), ("pay", 4, "arg4", "7", "literal"),
    ("set", 0, "p", "true", "literal"), ("set", 1, "arg1", "'a", "literal"), ("set", 2, "arg2", "b'", "unknown"), ("set", 3, "arg3", "total + 1", "state"), ("set", 4, "arg4", "0x1F", "literal"),
    ("one", 0, "arg0", "local[2]", "local"), ("one", 1, "arg1", "address(this)", "literal"), ("one", 2, "arg2", "x.y", "unknown"),
]


@query(f"with {spread_sql(ARGUMENTS, 'a', 'call, i, param, value, source_kind')} select k, call, i::int as i, param, value, source_kind from a")
def positional_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark, sf_dir, CALLS, "call string, args string, callee array<string>, caller array<string>, state array<string>")
    mapped = calls.positional_args(F.col("args"), F.col("callee"), F.col("caller"), F.col("state"))
    return rows.select("k", "call", F.posexplode(mapped).alias("i", "a")).select("k", "call", "i", "a.param", "a.value", "a.source_kind")


WRITERS = [("f:a", "a", ["x = 1", "y = 2", "x = 1", "z = 3"]), ("f:b", "b", [" t += 1 ", "u = 0"]), ("f:c", "c", []), ("f:d", "d", ["d = 4"])]
CALLED = [("f:a", "f:b", 0, []), ("f:a", "f:b", 1, [("p", "to", "input"), ("", "", "")]), ("f:a", "f:c", 2, []), ("f:c", "f:d", 3, [("p", "1", "literal")] * 4), ("f:c", "f:d", 4, []), ("f:x", "f:d", 5, [])]
PATHS = [
    ("f:a", "self -> x = 1", "high"), ("f:a", "self -> y = 2", "high"), ("f:a", "internal call -> b -> t += 1", "heuristic"), ("f:a", "p <- to (input) -> b -> t += 1", "heuristic"), ("f:a", "arg <- ? (unknown) -> b -> t += 1", "heuristic"),
    ("f:b", "self ->  t += 1 ", "high"), ("f:b", "self -> u = 0", "high"), ("f:c", "p <- 1 (literal) -> d -> d = 4", "heuristic"), ("f:c", "internal call -> d -> d = 4", "heuristic"), ("f:d", "self -> d = 4", "high"),
]


@query(f"with {spread_sql(PATHS, 'p', 'id, path, confidence', id='concat(k, id)')} select id, path, confidence from p")
def callee_write_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = spread(spark, sf_dir, WRITERS, "id string, label string, writes array<string>", id="concat(k, id)")
    called = [(*r[:3], "function_to_function", [dict(zip(("param", "value", "source_kind"), a)) for a in r[3]]) for r in CALLED]
    edges = spread(spark, sf_dir, called, "source string, target string, ord int, kind string, args_map array<struct<param:string,value:string,source_kind:string>>", source="concat(k, source)", target="concat(k, target)")
    return calls.write_paths(functions, edges).select("id", "path", "confidence")


_SQL_EXTERNAL = """case when event_type = 'error' or contains(lower(name), 'syscall') or regexp_matches(name, '^(SYS_|__NR_)') then 'unresolved_syscall' when regexp_matches(name, '^fd_') or regexp_matches(lower(name), '^(pthread_|epoll_|ioctl_)') or lower(name) = 'ioctl' then 'unresolved_lib'
when contains(lower(name), '->') or contains(lower(name), '(*') or contains(lower(name), 'fnptr') or contains(lower(name), 'callback') then 'unresolved_fnptr' when contains(name, '::') or contains(name, '.') then 'unresolved_lib' else 'unresolved_symbol' end"""
SYMBOLS = ["SYS_read", "my_Syscall", "fd_pool_new", "Pthread_join", "ioctl", "on_callback", "a->b", "std::move", "obj.run", "plain", "__NR_open"]


@query(f"""with names as (select *, ([{', '.join(map(literal, SYMBOLS))}])[(event_id % {len(SYMBOLS)})::int + 1] as name from events)
select event_type, name, {_SQL_EXTERNAL} as class, count(*)::bigint as n from names group by all""")
def external_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (F.col("event_id") % len(SYMBOLS) + 1).cast("int"))
    kind = F.when(F.col("event_type") == "error", "function_to_system").otherwise("function_to_function")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", name.alias("name"), kind.alias("kind"))
    return rows.groupBy("event_type", "name", calls.external_class(F.col("kind"), F.col("name")).alias("class")).agg(F.count("*").alias("n"))


# --- Solidity graph ----------------------------------------------------------------------------------------------------

TOKEN = """// a bank
contract Base {
  address owner;
  event Moved(address a);
  modifier onlyOwner() { require(msg.sender == owner); _; }
  function init(address who) public { owner = who; check(who); emit Moved(who); }
  function check(address who) internal { assert(who != address(0)); }
}
contract Bank is Base {
  uint total;
  mapping(address => uint) paid;
  function give(uint x) external onlyOwner { total = total + x; emit Moved(msg.sender); emit Unknown(x); }
  function take(uint x) external { paid[msg.sender] = x; give(x); check(msg.sender); owner = msg.sender; }
  function old_give(uint x) private { _give(x); revert("no"); }
}
"""
SOLIDITY_EDGES = [
    ("state:Base.owner", "function:Base.init", "state_to_function"),
    ("function:Base.init", "function:Base.check", "function_to_function"),
    ("function:Base.check", "external:assert", "function_to_system"),
    ("state:Bank.total", "function:Bank.give", "state_to_function"),
    ("function:Base.init", "event:Base.Moved", "function_to_event"),
    ("state:Bank.paid", "function:Bank.take", "state_to_function"),
    ("function:Bank.take", "function:Bank.give", "function_to_function"),
    ("function:Bank.take", "function:Base.check", "cross_type_call"),
    ("state:Base.owner", "function:Bank.take", "cross_type_state"),
    ("function:Bank.old_give", "external:revert", "function_to_system"),
]


def _own(c: str, *names: str) -> str:
    """SQL that puts the key behind some names."""
    for n in names:
        c = f"replace({c}, '{n}', concat('{n}', k))"
    return c


def _bank(c: str) -> str:
    return _own(c, "Bank", "Base")


def _token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, [("t/Bank.sol", 0, "solidity", TOKEN)], code.SOURCES, path=_AT, content=_bank("content")).drop("k")


@query(f"with {spread_sql(SOLIDITY_EDGES, 'e', 'source, target, kind', source=_bank('source'), target=_bank('target'))} select source, target, kind from e")
def solidity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of contracts, whose events and modifiers are their own."""
    return payload.edges_of(*adapters.model(_token(spark, sf_dir))).select("source", "target", "kind")


SOLIDITY_NODES = [
    ("type:Base", "type", ""), ("type:Bank", "type", ""), ("function:Base.init", "function", "type:Base"), ("function:Base.check", "function", "type:Base"),
    ("function:Bank.give", "function", "type:Bank"), ("function:Bank.take", "function", "type:Bank"), ("function:Bank.old_give", "function", "type:Bank"),
    ("state:Base.owner", "state", "type:Base"), ("state:Bank.total", "state", "type:Bank"), ("state:Bank.paid", "state", "type:Bank"),
    ("event:Base.Moved", "event", "type:Base"), ("modifier:Base.onlyOwner", "modifier", "type:Base"), ("modifier:Bank.onlyOwner", "modifier", "type:Bank"), ("external:assert", "external", ""), ("external:revert", "external", ""),
]


@query(f"with {spread_sql(SOLIDITY_NODES, 'n', 'id, grp, parent', id=_bank('id'), parent=_bank('parent'))} select distinct id, grp, parent from n")
def solidity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = payload.nodes_of(*adapters.model(_token(spark, sf_dir)))
    return nodes.select("id", F.col("group").alias("grp"), "parent").distinct()


OBJECTS = """interface IFeed { function rate(uint x) external; }
interface ISink is IFeed { function push(uint x) external; }
contract Store { uint used; function put(uint x) public { used = x; } }
contract Shop is Store {
  Store public store;
  Store old_store = Store(address(1));
  IFeed feed;
  function sell(uint x) public { store.put(x); old_store.put(x); store.put (x + 1); store.get(x); rate(x); }
  function idle() public { my_store.put(1); store = Store(address(2)); }
  Late late;
}
contract Late { Shop shop; function push(uint x) public { shop.sell(x); } }
"""
OBJECT_EDGES = [
    ("Shop", "sell", "Shop", "store", "function_to_object", "put"),
    ("Shop", "sell", "Shop", "store", "function_to_object", "put "),
    ("Shop", "sell", "Shop", "store", "function_to_object", "get"),
    ("Shop", "sell", "Shop", "old_store", "function_to_object", "put"),
    ("Late", "push", "Late", "shop", "function_to_object", "sell"),
]
INTERFACE_EDGES = [
    ("Store", "used", "Store", "put", "state_to_function"),
    ("Shop", "sell", "IFeed", "rate", "cross_type_call"),
    ("Shop", "sell", "Store", "put", "cross_type_call"),
    ("Shop", "idle", "Store", "put", "cross_type_call"),
    ("Shop", "sell", "Shop", "store", "function_to_object"),
    ("Shop", "sell", "Shop", "old_store", "function_to_object"),
    ("Late", "push", "Late", "shop", "function_to_object"),
]


def _types(c: str) -> str:
    return _own(c, "Store", "Shop", "Late", "IFeed", "ISink")


_TYPED = {"source_type": _types("source_type"), "target_type": _types("target_type")}


def _shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    src = spread(spark, sf_dir, [("t/Shop.sol", 0, "solidity", OBJECTS)], code.SOURCES, path=_AT, content=_types("content")).drop("k")
    return Facts(spark).contracts(src), src


@query(f"with {spread_sql(OBJECT_EDGES, 'e', 'source_type, source_name, target_type, target_name, kind, label', **_TYPED)} select * exclude (k) from e")
def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods called on objects: a type counts once it is declared, whatever follows an underscore doesn't."""
    return solidity_graph.object_edges(_shop(spark, sf_dir)[0]).drop("path")


@query(f"with {spread_sql(INTERFACE_EDGES, 'e', 'source_type, source_name, target_type, target_name, kind', **_TYPED)} select * exclude (k) from e")
def interface_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of contracts that name an interface without inheriting from it."""
    contracts, src = _shop(spark, sf_dir)
    return solidity_graph.edges(contracts, solidity_graph.events_of(solidity_graph.own_texts(src, contracts))).drop("path")


@query()
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_nationkey") % 5).alias("grp"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return solidity_rules.similar_names(s, ["grp"]).select("grp", "a_name", "b_name")
