"""Queries over views of graphs and scans, and over declarations, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import extract, views
from quarry.plans.models import literal, spread, spread_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- payloads -----------------------------------------------------------------------------------------------------------

GROUPS = ["type", "state", "function", "odd", "syscall", "tile"]
KINDS = ["function_to_system", "function_to_function", "strange", "tile_to_tile", "pointer_flow", "function_to_workspace", "function_to_event"]
_pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.expr(n) % len(xs) + 1).cast("int"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, item = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    nodes = part.selectExpr("case when p_partkey % 31 = 0 then '' else concat('p', p_partkey - (p_partkey % 3) div 2) end as id", "p_size", "p_partkey as ord")
    edges = item.selectExpr("case when l_orderkey % 29 = 0 then '' else concat(l_orderkey, '-', l_linenumber div 2) end as id", "concat('p', l_partkey) as source", "concat('p', l_suppkey) as target", "l_linenumber", "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey as ord")
    return nodes.select("id", _pick(GROUPS, "p_size").alias("group"), "ord"), edges.select("id", "source", "target", _pick(KINDS, "l_linenumber").alias("kind"), "ord")


_GRAPH = f"""with n0 as (select case when p_partkey % 31 = 0 then '' else 'p' || (p_partkey - (p_partkey % 3) // 2) end as id, {literal(GROUPS)}[(p_size % {len(GROUPS)})::int + 1] as grp, p_partkey as ord from part),
e0 as (select case when l_orderkey % 29 = 0 then '' else l_orderkey || '-' || (l_linenumber // 2) end as id, 'p' || l_partkey as source, 'p' || l_suppkey as target, {literal(KINDS)}[(l_linenumber % {len(KINDS)})::int + 1] as kind, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey as ord from lineitem),
n1 as (select * from n0 where id <> '' qualify row_number() over (partition by id order by ord) = 1),
n as (select id, ord, case grp when 'type' then 'tile' when 'state' then 'workspace' when 'odd' then 'external' else grp end as grp, case when grp = 'odd' then grp end as experimental from n1),
e1 as (select * from e0 where id <> '' and source in (select id from n) and target in (select id from n) qualify row_number() over (partition by id order by ord) = 1),
e as (select id, source, target, ord, case when kind = 'function_to_system' then 'function_to_syscall' when kind in ('strange', 'function_to_event') then 'pointer_flow' else kind end as kind, case when kind in ('strange', 'function_to_event') then kind end as experimental from e1)
"""


@query(_GRAPH + "select id, grp, ord, experimental from n")
def normalized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.normalize(*_graph(spark, sf_dir))[0].select("id", F.col("group").alias("grp"), "ord", "experimental")


@query(_GRAPH + f"select id, source, target, kind, experimental, list_contains({literal(views.HEURISTIC_KINDS)}, kind) as is_heuristic, case when kind in ('function_to_syscall', 'tile_to_tile') then 'high' else 'heuristic' end as confidence from e")
def normalized_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.normalize(*_graph(spark, sf_dir))[1].select("id", "source", "target", "kind", "experimental", *views.edge_facts(F.col("kind")))


@query(_GRAPH + f", c as (select (select count(*) from n)::bigint as node_count, (select count(*) from e)::bigint as edge_count) select *, true as call_edges_are_heuristic, node_count > {views.MANY_NODES} or edge_count > {views.MANY_EDGES} as large_graph_warning from c")
def exploration_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.normalize(*_graph(spark, sf_dir))
    # a merged bundle is checked again: nothing changes
    return views.hints(*views.normalize(nodes.drop("experimental"), edges.drop("experimental")))


# --- filters, badges, rings ---------------------------------------------------------------------------------------------


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand", "concat('p', p_partkey) as id", "case when p_size % 4 = 0 then 'state' else 'function' end as group", "p_partkey % 5 = 0 as is_entrypoint", "case when p_size % 7 > 0 then slice(split(p_type, ' '), 1, p_size % 3) end as state_writes", "slice(split(p_type, ' '), 1, p_size % 3) as rings")


_WRITERS = """with f as (select p_brand, 'p' || p_partkey as id, p_size % 4 <> 0 as fn, p_partkey % 5 = 0 as entry, case when p_size % 7 > 0 then len(list_slice(string_split(p_type, ' '), 1, p_size % 3)) else 0 end as writes, list_slice(string_split(p_type, ' '), 1, p_size % 3) as rings from part)
"""


@query(_WRITERS + "select p_brand, count(*)::bigint as nodes, count(*) filter (fn and writes > 0)::bigint as writers, count(*) filter (fn and writes > 0 and entry)::bigint as entry_writers from f group by all")
def badge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.badges(_functions(spark, sf_dir), "p_brand")


@query(_WRITERS + ", w as (select id from f where fn and writes > 0 and entry) select l_orderkey, l_linenumber, 'p' || l_partkey as source, 'p' || l_suppkey as target from lineitem where 'p' || l_partkey in (select id from w) or 'p' || l_suppkey in (select id from w)")
def writer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "concat('p', l_partkey) as source", "concat('p', l_suppkey) as target")
    return views.touching(edges, _functions(spark, sf_dir).where(views.writes_state(True)))


@query(_WRITERS + """, r as (select id, p_brand, len(rings) as k, unnest(rings) as name, generate_subscripts(rings, 1) as i from f)
select id || '::ring::' || (i - 1) as id, case when i = 1 then p_brand else id || '::ring::' || (i - 2) end as parent, 'modifier_ring' as grp, name from r
union all select id, case when len(rings) > 0 then id || '::ring::' || (len(rings) - 1) else p_brand end, 'function', '' from f""")
def modifier_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rings(_functions(spark, sf_dir).withColumnRenamed("p_brand", "parent")).withColumnRenamed("group", "grp")


@query("select p_partkey, case when p_size % 3 = 0 then 'high' else 'low' end as confidence from part where p_size % 3 = 0")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings, of which those that are sure stay."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return views.with_confidence(parts.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "high").otherwise("low").alias("confidence")), "high")


@query("""with d as (select distinct l_partkey % 3000 as k from lineitem), r as (select distinct p_partkey as k from part where p_size > 10)
select k, 'unregistered' as drift from (select k from d except select k from r) union all select k, 'undeclared' from (select k from r except select k from d)""")
def registry_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are sold and those that are listed: what only one side has."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return views.drift(t("lineitem").select((F.col("l_partkey") % 3000).alias("k")), t("part").where("p_size > 10").select(F.col("p_partkey").alias("k")), "k")


# --- formatted values ---------------------------------------------------------------------------------------------------

_SIZES = """with s as (select event_id, (event_id * event_id * 37) % 5000000 as b, (event_id * 71) % 9000 as ms, ts from events)"""


@query(_SIZES + """, k as (select *, (b * 20 + 1024) // 2048 as kb, (b * 200 + 1048576) // 2097152 as mb, (ms + 5) // 10 as cs, case when event_id % 3 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') else strftime(ts, '%Y-%m-%d') end as iso from s)
select event_id, case when b < 1024 then b || ' B' when b < 1048576 then (kb // 10) || '.' || (kb % 10) || ' KB' else (mb // 100) || '.' || lpad((mb % 100)::varchar, 2, '0') || ' MB' end as size,
case when ms < 1000 then ms || ' ms' else (cs // 100) || '.' || lpad((cs % 100)::varchar, 2, '0') || ' s' end as duration, case when event_id % 7 = 0 then '-' when contains(iso, 'T') then left(regexp_replace(iso, 'T', ' '), 19) else iso end as at from k""")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    b, ms = F.expr("event_id * event_id * 37 % 5000000"), F.expr("event_id * 71 % 9000")
    iso = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", views.format_size(b).alias("size"), views.format_duration(ms).alias("duration"), views.format_timestamp(iso).alias("at"))


@query("""select page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\\.[^.]+$', ''), '[^a-zA-Z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'scan-' || page_id) as name from pages""")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", views.export_name(F.col("url"), F.col("page_id")).alias("name"))


PLACES = [(1, "Vault", "take", [3, 5], 3), (2, "Vault", "", [], None), (3, "", None, [], 7), (4, None, "f", None, 0), (5, None, None, None, None), (6, "", "", [2], 9)]
PLACED = [(1, "Vault.take (lines: 3, 5)"), (2, "Vault"), (3, "lines: 7"), (4, "f (lines: 0)"), (5, "unknown"), (6, "lines: 2")]


@query(f"with {spread_sql(PLACED, 'p', 'id, place')} select k, id::bigint as id, place from p")
def finding_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark, sf_dir, PLACES, "id long, t string, f string, lines array<int>, line int")
    return rows.select("k", "id", views.location(F.col("t"), F.col("f"), F.col("lines"), F.col("line")).alias("place"))


# --- declarations -------------------------------------------------------------------------------------------------------

TOKEN = """import "./First.sol";
import "./Base.sol";
  // import "./Old.sol";
import {A, B} from "./Two.sol"; // both
/* event Gone(uint x);
*/ contract Bank is Base { using SafeMath for uint256; string home = "http://bank.example/x";
  event Paid(address who, uint sum); event Closed ();
  function a() public { oracle.read(1); _oracle.hide(); oracle.read(2); } }
"""
UNIFIED = """import "./First.sol"; --.--import "./Base.sol"; --.--import {A, B} from "./Two.sol"; --.-- contract Bank is Base { using SafeMath for uint256; string home = "http://bank.example/x"; --.-- event Paid(address who, uint sum); event Closed (); --.-- function a() public { oracle.read(1); _oracle.hide(); oracle.read(2); } }"""
DECLARED = [("import", '"./Base.sol"', ""), ("import", '{A, B} from "./Two.sol"', ""), ("using", "using SafeMath for uint256;", ""), ("event", "Paid", "(address who, uint sum);"), ("event", "Closed", "();"), ("call", "read", "")]


_NAMED_BANK = "replace({}, 'Bank', concat('Bank', k))"


@query(f"with {spread_sql([(UNIFIED,)], 'u', 'text', text=_NAMED_BANK.format('text'))} select text from u")
def unified_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, [(TOKEN,)], "c string", c=_NAMED_BANK.format("c")).select(extract.unified("c").alias("text"))


@query(f"with {spread_sql(DECLARED, 'd', 'kind, name, params')} select * from d")
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    text = spread(spark, sf_dir, [(TOKEN,)], "c string").select("k", extract.unified("c").alias("c"))
    row = lambda kind, name, params=F.lit(""): F.struct(F.lit(kind).alias("kind"), name.alias("name"), params.alias("params"))
    words = extract.using(c)
    found = F.concat(
        F.transform(extract.imports(c), lambda x: row("import", x)),
        F.when(F.size(words) > 0, F.array(row("using", F.array_join(words, " ")))).otherwise(F.array().cast("array<struct<kind:string,name:string,params:string>>")),
        F.transform(extract.events(c), lambda e: row("event", e["name"], e["params"])),
        F.transform(extract.object_calls(c, F.lit("oracle")), lambda x: row("call", x)),
    )
    return text.select("k", F.inline(found))


PARAMS = [
    ("f", "struct pool * p, txn_t * t, int n", "p->head = t->size; p->head++; t -> owner = n; q->gone = 1;"),
    ("g", "void", "p->head = 0;"),
    ("h", "char * s, pool_t *", "s->x = 1;"),
    ("k", "struct txn_t * p, struct pool * p2, unsigned", "p->size = p2->head + p->size;"),
    ("none", "", ""),
]
STRUCTS = ["pool", "txn_t", "pool_t"]
FIELDS = [("f", "pool", "head", "p"), ("f", "txn_t", "size", "t"), ("f", "txn_t", "owner", "t"), ("k", "txn_t", "size", "p"), ("k", "pool", "head", "p2")]
NAMED = [("f", "p,t,n"), ("g", ""), ("h", "s,arg1"), ("k", "p,p2,unsigned"), ("none", "")]


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark, sf_dir, PARAMS, "fn string, params string, body string")
    return rows.withColumn("inputs", extract.inputs(F.col("params")))


@query(f"with {spread_sql(NAMED, 'n', 'fn, names')} select * from n")
def param_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(spark, sf_dir).select("k", "fn", F.array_join(extract.param_names(F.col("inputs")), ",").alias("names"))


@query(f"with {spread_sql(FIELDS, 'f', 'fn, struct_name, field, via')} select * from f")
def field_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _params(spark, sf_dir).withColumn("bindings", extract.struct_bindings(F.col("inputs"), F.array(*[F.lit(s) for s in STRUCTS])))
    return extract.field_hints(bound, ["k", "fn"]).withColumnRenamed("struct", "struct_name")


HEADER = "typedef struct { int a; union { int b; } u; } pool_t;\ntypedef struct node { int v; } node;\ntypedef struct big { int v; } big_t;\ntypedef struct { int v; } x; typedef struct { int v; } size_t; typedef struct later later_t;"


@query("select s_suppkey as k, unnest(['big' || s_suppkey || '_t', 'pool' || s_suppkey || '_t']) as name from supplier")
def typedef_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = "replace(replace(c, 'pool_t', concat('pool', k, '_t')), 'big_t', concat('big', k, '_t'))"
    return spread(spark, sf_dir, [(HEADER,)], "c string", c=named).select("k", F.explode(extract.typedef_structs(F.col("c"), F.array(F.lit("node"), F.lit("big")))).alias("name"))


@query("""with l as (select conv_id, turn, unnest(string_split(text, ' ')) as w from conversations), s as (select distinct conv_id, w from l where turn = 0 and length(w) > 6)
select c.conv_id, string_agg(distinct c.turn, ',' order by c.turn) as line_numbers from conversations c join s on s.conv_id = c.conv_id and contains(trim(c.text), s.w) group by all""")
def callsite_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("n"), F.col("text").alias("line"))
    sites = lines.where("n = 0").select("conv_id", F.explode(F.split("line", " ", -1)).alias("site")).where(F.length("site") > 6).distinct()
    return extract.callsite_lines(lines, sites, ["conv_id"]).select("conv_id", F.array_join(F.col("line_numbers").cast("array<string>"), ",").alias("line_numbers"))
