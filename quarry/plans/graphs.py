"""Graph payloads over the given tables: suppliers are types, parts their functions, line items the calls between them.

A nation's suppliers share a file, whose language follows its key, so graphs of all languages come out of one stream. The SQL
resolves names, allots ids, derives paths of writes and validates by its own formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import text as T
from quarry.operators import payload
from quarry.operators.frames import bracket_pairs, first_per_place, ranked
from quarry.operators.views import EDGE_KINDS, HEURISTIC_KINDS, NODE_GROUPS
from quarry.plans.models import literal

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Kinds of edges by the order's key modulo seven.
KINDS = ("function_to_function", "state_to_function", "function_to_event", "function_to_modifier", "function_to_system", "function_to_system", "function_to_function")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of payload.NODE and payload.EDGE from suppliers and line items."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = F.col("s_nationkey")
    language = F.element_at(F.array(F.lit("c"), F.lit("rust"), F.lit("solidity")), nation % 3 + 1)
    suffix = F.element_at(F.array(F.lit(".c"), F.lit(".rs"), F.lit(".sol")), nation % 3 + 1)
    files = t("supplier").select("s_suppkey", F.concat(F.lit("./src/n"), nation.cast("string"), suffix).alias("path"), language.alias("language"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("type_name"))
    items = t("lineitem").join(files, F.col("l_suppkey") == F.col("s_suppkey"))
    first = F.col("s_suppkey") * 10_000
    # names are told apart by keys, before they become rows with texts
    of = lambda group, base, c: t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), c.alias("x")).distinct().join(files, "s_suppkey").select("path", "language", "type_name", (first + base + F.conv(F.substring(F.sha2(F.col("x").cast("string"), 256), 1, 3), 16, 10).cast("long")).alias("ord"), F.lit(group).alias("group"), "x")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    node = lambda df, **c: payload.rows(df, payload.NODE, **c)
    x = F.col("x")
    writes = F.when(x % 5 == 0, F.array(F.concat(F.lit("s"), x.cast("string"), F.lit(" = v")))).otherwise(F.array().cast("array<string>"))
    nodes = node(files, group="type", label=F.col("type_name"), ord=first)
    nodes = nodes.unionByName(node(of("function", 1, F.col("l_partkey") % 40), label=text("f", x), is_entrypoint=x % 2 == 0, state_writes=writes))
    nodes = nodes.unionByName(node(of("state", 5000, F.col("l_linenumber")), label=text("s", x)))
    nodes = nodes.unionByName(node(of("event", 1, F.col("l_returnflag")), label=text("Ev", x)))
    nodes = nodes.unionByName(node(of("modifier", 1, F.col("l_linestatus")), label=text("only", x)))
    includes = files.where((F.col("language") == "c") & (F.col("s_suppkey") % 2 == 0))
    nodes = nodes.unionByName(node(includes, group="state", label="inc:x", ord=first + 9999))
    order = F.col("l_orderkey")
    kind = order % 7
    names = [text("f", order % 45), text("s", F.col("l_linenumber")), text("Ev", F.col("l_returnflag")), text("only", F.col("l_linestatus")), text("fd_", order % 10), text("SYS_", order % 5), F.lit("")]
    value = F.col("l_quantity").cast("long").cast("string")
    args = F.when((kind == 0) & (F.col("l_linenumber") < 3), F.array(F.struct(F.lit("p").alias("param"), value.alias("value"), F.lit("literal").alias("source_kind")))).otherwise(F.array().cast("array<struct<param:string,value:string,source_kind:string>>"))
    edges = payload.rows(items, payload.EDGE, ord=(order * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey"), source_type=F.col("type_name"), source_name=text("f", F.col("l_partkey") % 40), target_type=text("T", F.col("s_suppkey") + F.col("l_linenumber") % 3), target_name=F.element_at(F.array(*names), (kind + 1).cast("int")), kind=F.element_at(F.array(*[F.lit(k) for k in KINDS]), (kind + 1).cast("int")), args_map=args)
    anchors = payload.rows(includes, payload.EDGE, ord=F.col("s_suppkey") - 1_000_000_000, source_type=F.col("type_name"), source_name=payload.INCLUDER, target_type=F.col("type_name"), target_name="inc:x", kind="function_to_include_template")
    return nodes, edges.unionByName(anchors)


def _round(k: int) -> str:
    """One round of asking for names: state r{k} to r{k + 1}."""
    cand = "case k when 0 then base when 1 then base || '.' || left(sha256(id), 8) else base || '.' || k end"
    return f"""q{k} as materialized (select path, id, ord, base, k, {cand} as cand from r{k}),
r{k + 1} as materialized (select path, id, ord, base, k + (row_number() over (partition by path, cand order by ord, id) > 1)::int as k, cand from q{k})"""


_ROUNDS = 4
_PICK = "case o % 7 when 0 then 'f' || (o % 45) when 1 then 's' || l_linenumber when 2 then 'Ev' || l_returnflag when 3 then 'only' || l_linestatus when 4 then 'fd_' || (o % 10) when 5 then 'SYS_' || (o % 5) else '' end"
_MODEL = f"""s as materialized (select s_suppkey as k, './src/n' || s_nationkey || (['.c', '.rs', '.sol'])[s_nationkey % 3 + 1] as path, (['c', 'rust', 'solidity'])[s_nationkey % 3 + 1] as language, 'T' || s_suppkey as t from supplier),
l as materialized (select s.*, l_orderkey as o, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_quantity from lineitem join s on l_suppkey = k),
h as (select distinct k, path, language, t, 'function' as g, 1 as b, (l_partkey % 40)::varchar as x, 'f' as p from l
  union all select distinct k, path, language, t, 'state', 5000, l_linenumber::varchar, 's' from l
  union all select distinct k, path, language, t, 'event', 1, l_returnflag, 'Ev' from l
  union all select distinct k, path, language, t, 'modifier', 1, l_linestatus, 'only' from l),
n as (select path, language, t, k * 10000 as ord, 'type' as g, t as label, [] as writes, 'type:' || t as id, '' as parent from s
  union all select path, language, t, k * 10000 + b + ('0x' || left(sha256(x), 3))::int, g, p || x, case when g = 'function' and x::int % 5 = 0 then ['s' || x || ' = v'] else [] end, g || ':' || t || '.' || p || x, 'type:' || t from h where g = 'function'
  union all select path, language, t, k * 10000 + b + ('0x' || left(sha256(x), 3))::int, g, p || x, [], g || ':' || t || '.' || p || x, 'type:' || t from h where g <> 'function'
  union all select path, language, t, k * 10000 + 9999, 'state', 'inc:x', [], 'state:' || t || '.inc:x', 'type:' || t from s where language = 'c' and k % 2 = 0),
m as materialized (select *, case g when 'function' then 0 when 'state' then 1 when 'event' then 2 when 'modifier' then 3 end as prio from n),
e as materialized (select path, language, (o * 8 + l_linenumber) * 1000000 + l_partkey as ord, t as st, 'f' || (l_partkey % 40) as sn, 'T' || (k + l_linenumber % 3) as tt, {_PICK} as tn, {literal(list(KINDS))}[o % 7 + 1] as kind, case when o % 7 = 0 and l_linenumber < 3 then l_quantity::bigint end as arg from l
  union all select path, language, k - 1000000000, t, '{payload.INCLUDER}', t, 'inc:x', 'function_to_include_template', null from s where language = 'c' and k % 2 = 0),
i as (select path, t, label, id from m where prio is not null qualify row_number() over (partition by path, t, label order by prio, ord, id) = 1),
a as (select path, label, id from m where prio is not null qualify row_number() over (partition by path, label order by prio, ord, id) = 1),
c as (select *, case when kind = 'function_to_system' or starts_with(tn, 'SYS_') then 'unresolved_syscall' when starts_with(tn, 'fd_') then 'unresolved_lib' else 'unresolved_symbol' end as class from e where tn <> ''),
u as materialized (select c.path, c.language, c.ord, kind, arg, tn, case when sn = '{payload.INCLUDER}' then 'type:' || st else si.id end as source, coalesce(ti.id, ta.id, 'external:' || case when c.language = 'c' then class || ':' else '' end || tn) as target
  from c left join i si on si.path = c.path and si.t = st and si.label = sn left join i ti on ti.path = c.path and ti.t = tt and ti.label = tn left join a ta on ta.path = c.path and ta.label = tn),
x as (select path, language, '' as t, min(ord * 2 + 1 + 1099511627776) as ord, 'external' as g, tn as label, [] as writes, target as id, '' as parent from u where starts_with(target, 'external:') group by path, language, tn, target),
w as materialized (select path, language, t, ord, g, label, writes, id, parent from m union all select * from x),
r0 as (select path, id, ord, 0 as k, case g when 'type' then 'tile:' || label when 'state' then 'workspace:' || label when 'function' then 'function:' || substr(path, 3) || '.' || label when 'external' then id else id end as base from w where language = 'c'),
{", ".join(_round(k) for k in range(_ROUNDS))},
z as materialized (select path, id, cand as new from r{_ROUNDS}),
wn as materialized (select w.*, coalesce(z.new, w.id) as nid, coalesce(y.new, w.parent) as nparent from w left join z on z.path = w.path and z.id = w.id left join z y on y.path = w.path and y.id = w.parent),
un as materialized (select u.*, coalesce(z.new, source) as ns, coalesce(y.new, target) as nt from u left join z on z.path = u.path and z.id = source left join z y on y.path = u.path and y.id = target),
own as (select path, nid, -1 as ord, 'self -> ' || writes[1] as p, 'high' as conf from wn where g = 'function' and len(writes) > 0),
via as (select f.path, f.nid, un.ord, case when arg is not null then 'p <- ' || arg || ' (literal) -> ' else 'internal call -> ' end || d.label || ' -> ' || d.writes[1] as p, 'heuristic' as conf
  from un join wn f on f.path = un.path and f.nid = ns and f.g = 'function' join wn d on d.path = un.path and d.nid = nt and d.g = 'function' and len(d.writes) > 0 where kind = 'function_to_function'),
ways as (select path, nid, string_agg(p || '|' || conf, ';' order by ord) as write_paths from (select path, nid, p, min(ord) as ord, min_by(conf, ord) as conf from (select * from own union all select * from via) group by path, nid, p) group by path, nid),
told as (select path, ns, bool_or(kind = 'function_to_function') as f, bool_or(kind = 'function_to_system') as sy, bool_or(kind = 'function_to_event') as ev, bool_or(kind = 'function_to_include_template') as inc from un group by path, ns)"""
_GROUP = "case when language = 'c' then case g when 'type' then 'tile' when 'state' then 'workspace' else g end else g end"
_KIND = "case when language = 'c' and kind = 'function_to_system' then 'function_to_syscall' else kind end"
_IN = lambda c, xs: f"{c} in ({', '.join(map(literal, xs))})"


def _shown_nodes(df: DataFrame) -> DataFrame:
    ways = F.array_join(F.transform("write_paths", lambda p: F.concat(p["path"], F.lit("|"), p["confidence"])), ";")
    return df.select("path", "id", "group", "label", "parent", "experimental", F.nullif(ways, F.lit("")).alias("write_paths"), "calls_internal", "calls_system", "calls_event", "calls_include_template")


_EDGES = f"""select path, 'edge:' || ord as id, ns as source, nt as target, case when language = 'c' and not {_IN(_KIND, EDGE_KINDS)} then 'pointer_flow' else {_KIND} end as kind,
  case when language = 'c' then {_IN(_KIND, HEURISTIC_KINDS)} end as is_heuristic, case when language = 'c' then case when {_IN(_KIND, HEURISTIC_KINDS)} then 'heuristic' else 'high' end end as confidence,
  case when language = 'c' and not {_IN(_KIND, EDGE_KINDS)} then {_KIND} end as experimental from un"""
_NODES = f"""select wn.path, wn.nid as id, case when language = 'c' and not {_IN(_GROUP, NODE_GROUPS)} then 'external' else {_GROUP} end as "group", label, nparent as parent, case when language = 'c' and not {_IN(_GROUP, NODE_GROUPS)} then {_GROUP} end as experimental,
  case when g = 'function' then write_paths end as write_paths, case when g = 'function' then coalesce(f, false) end as calls_internal, case when g = 'function' then coalesce(sy, false) end as calls_system, case when g = 'function' then coalesce(ev, false) end as calls_event,
  case when g = 'function' then language = 'c' and coalesce(k % 2 = 0, false) end as calls_include_template
from wn left join ways using (path, nid) left join told on told.path = wn.path and told.ns = wn.nid left join s on s.t = wn.t"""
_NODES = _NODES.replace("case when language", "case when wn.language").replace("then language = 'c'", "then wn.language = 'c'")


@query(f"with {_MODEL} {_NODES}")
def payload_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all files: ids, groups, parents, paths of writes and what functions call."""
    return _shown_nodes(payload.nodes_of(*model(spark, sf_dir)))


@query(f"with {_MODEL} {_EDGES}")
def payload_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all files between checked ids, with how sure they are."""
    return payload.edges_of(*model(spark, sf_dir)).select("path", "id", "source", "target", "kind", "is_heuristic", "confidence", "experimental")


_TAG = "regexp_extract(path, '[^/]*$')"


@query(f"""with {_MODEL}, e0 as ({_EDGES}), anchors as (select path, min_by({_TAG} || '::' || nid, label) as a from wn where g = 'type' group by path),
pairs as (select distinct p.path as path, p.a as source, q.a as target, case when p.path like '%.c' then 'tile_to_tile' else 'bundle_import' end as kind from anchors p join anchors q on regexp_extract(q.path, '(\\d+)\\.', 1)::int = regexp_extract(p.path, '(\\d+)\\.', 1)::int + 3)
select {_TAG} || '::' || id as id, {_TAG} || '::' || source as source, {_TAG} || '::' || target as target, kind from e0
union all select 'bundle:' || left(sha256(source || chr(0) || target || chr(0) || kind), 12), source, target, kind from pairs""")
def bundle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the merged graph of all files, where each imports the file whose nation comes three after its own, several times over."""

    def imports(files: DataFrame) -> DataFrame:
        numbered = files.select("path", F.regexp_extract("path", r"(\d+)\.", 1).cast("int").alias("at"))
        pairs = numbered.select(F.col("path").alias("consumer"), "at").join(numbered.select(F.col("path").alias("provider"), (F.col("at") - 3).alias("at")), "at")
        kind = F.when(F.endswith("consumer", F.lit(".c")), "tile_to_tile").otherwise("bundle_import")
        return pairs.select("consumer", "provider", kind.alias("kind"), F.lit("import").alias("label"), F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("col")

    return payload.bundled_edges(*model(spark, sf_dir), imports)


@query("""with o as (select l_orderkey as a, l_linenumber as n, bool_or(l_quantity::int % 4 = 0) as stop from lineitem group by all),
g as (select *, n - row_number() over (partition by a order by n) as run from o)
select a as chain, n as place, max(case when stop then n end) over (partition by a, run order by n) as found from g""")
def nearest_ancestor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items point to the one before them in their order; the nearest of a line and those before it whose quantity is divisible by four."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") - 1).alias("parent"), (F.col("l_quantity").cast("int") % 4 == 0).alias("stop"))
    items = items.groupBy("chain", "id", "parent").agg(F.bool_or("stop").alias("stop"))
    return payload.nearest_ancestor(items, ["chain"]).select("chain", F.col("id").alias("place"), "found")


@query("""with o as (select o_orderkey as id, row_number() over (order by o_orderkey) as r, count(*) over () as n from orders)
select id::bigint as id, max(case when r % 10007 = 3 then id end) over (order by r)::bigint as found from o""")
def nearest_ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one chain, each pointing to the order with the next lower key; every 10,007th stops."""
    orders = ranked(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), ["o_orderkey"], "r")
    chain = orders.select(F.col("r").alias("id"), (F.col("r") - 1).alias("parent"), (F.col("r") % 10007 == 3).alias("stop"), "o_orderkey")
    found = payload.nearest_ancestor(chain.select("id", "parent", "stop"), [])
    keys = chain.select(F.col("id").alias("found"), F.col("o_orderkey").alias("f"))
    return chain.select("id", F.col("o_orderkey").alias("key")).join(found, "id").join(keys, "found", "left").select(F.col("key").alias("id"), F.col("f").alias("found"))


_DEEP = 14


@query(f"""with r0 as (select 'f' || (p_partkey // 200) as path, 'n' || p_partkey as id, ((p_partkey * 7919) % 10007)::bigint as ord, 0 as k, 'tile:B' || ((p_partkey // 10) % 7) ||
  case p_partkey % 10 when 0 then '.' || left(sha256('n' || (p_partkey + 1)), 8) when 3 then '.2' when 5 then '.' || left(sha256('n' || (p_partkey + 1)), 8) || '.' || left(sha256('n' || (p_partkey - 3)), 8) else '' end as base from part),
{", ".join(_round(k) for k in range(_DEEP))}
select path, id, cand as stable from r{_DEEP}""")
def stable_c_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of tiles named after parts: labels that repeat, and labels that are what another would take as its second or third choice."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    digest = lambda c: F.left(F.sha2(F.concat(F.lit("n"), c.cast("string")), 256), F.lit(8))
    own = F.concat(F.lit("B"), (F.floor(key / 10) % 7).cast("string"))
    turn = key % 10
    label = F.when(turn == 0, F.concat(own, F.lit("."), digest(key + 1))).when(turn == 3, F.concat(own, F.lit(".2"))).when(turn == 5, F.concat(own, F.lit("."), digest(key + 1), F.lit("."), digest(key - 3))).otherwise(own)
    nodes = part.select(F.concat(F.lit("f"), F.floor(key / 200).cast("string")).alias("path"), F.concat(F.lit("n"), key.cast("string")).alias("id"), F.lit("tile").alias("group"), label.alias("label"), ((key * 7919) % 10007).alias("ord"))
    return payload.stable_ids(nodes)


#: Pages inside parentheses: up to 59 open, up to 49 closed.
_NESTED = "repeat('f(', (page_id % 60)::int) || html || repeat(')', (page_id % 50)::int)"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(_NESTED.replace("::int", "")).alias("t"))


_MARKS = f"""p as (select page_id, {_NESTED} as t from pages), c as (select page_id, unnest(range(1, length(t) + 1)) as pos, unnest(string_split(t, '')) as ch from p),
m as (select page_id, pos, case ch when '(' then 1 else -1 end as step, sum(case ch when '(' then 1 else -1 end) over (partition by page_id order by pos) as total from c where ch in ('(', ')')),
l as (select *, total - least(0, min(total) over (partition by page_id order by pos)) as level from m),
k as (select *, coalesce(lag(level) over (partition by page_id order by pos), 0) as before from l)"""


@query(f"""with {_MARKS}, o as (select page_id, pos, level as depth from k where step = 1), e as (select page_id, pos, before as depth from k where step = -1 and before > 0)
select o.page_id, o.pos::bigint as open, e.pos::bigint as close, o.depth::bigint as depth from o asof join e on o.page_id = e.page_id and o.depth = e.depth and o.pos < e.pos""")
def nested_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parenthesis of pages, wrapped up to 59 times, with its partner and depth."""
    found = bracket_pairs(_nested(spark, sf_dir), ["page_id"], "t")
    return found.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("open", "close", "depth")])


@query(f"""with {_MARKS}, f as (select page_id, min(pos) as a from m where step = 1 group by page_id), g as (select k.page_id, min(pos) as z from k join f on k.page_id = f.page_id and pos > a where level = 0 group by k.page_id)
select p.page_id, case when z is null then 0 else z end::int as n, md5(case when z is null then '' else left(t, z) end) as digest from p left join g using (page_id)""")
def balanced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages up to the parenthesis that closes their first one: length and digest."""
    span = T.balanced(F.col("t"))
    return _nested(spark, sf_dir).select("page_id", span.alias("s")).select("page_id", F.length("s").alias("n"), F.md5("s").alias("digest"))


_PATTERNS = ["[A-Z][a-z]*ing", "[A-Z][a-z]+", "[0-9]+", "[A-Z0-9]"]


@query("""with d as (select doc_id, text from documents where text is not null), """ + ", ".join(
    f"""x{k} as (select doc_id, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as b from d),
y{k} as (select doc_id, generate_subscripts(m, 1) as i, unnest(m) as found, unnest(b[1:len(m)]) as gap from x{k}),
z{k} as (select doc_id, {k} as rank, found, sum(length(gap) + length(found)) over (partition by doc_id order by i) - length(found) + 1 as place from y{k})""" for k, p in enumerate(_PATTERNS))
    + " select doc_id, place::bigint as place, rank::int as rank, found from (" + " union all ".join(f"select * from z{k}" for k in range(len(_PATTERNS))) + ") qualify row_number() over (partition by doc_id, place order by rank) = 1")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four patterns find in documents; of those that begin at one place the first pattern's."""
    found = first_per_place(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null"), ["doc_id"], "text", _PATTERNS)
    return found.select("doc_id", F.col("place").cast("long").alias("place"), "rank", "found")
