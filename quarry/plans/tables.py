"""The operators over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions import text as T
from quarry.operators import frames, graph, keyed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SQL_STATEMENTS = "list_filter(list_transform(string_split_regex({}, '[;\\n]'), lambda x: trim(regexp_replace(x, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'))), lambda x: length(x) > 2)"


@query(f"""with s as (select doc_id, {_SQL_STATEMENTS.format("coalesce(text, '')")} as st from documents)
select doc_id, len(st)::bigint as n_statements, coalesce(list_sum(list_transform(st, lambda x: length(x))), 0)::bigint as n_chars, coalesce(st[len(st)], '') as last_statement from s""")
def statement_split(spark, sf_dir):
    st = table(spark, sf_dir, "documents").select("doc_id", T.statements(F.coalesce("text", F.lit(""))).alias("st"))
    return st.select("doc_id", F.size("st").cast("long").alias("n_statements"), F.aggregate("st", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"), F.coalesce(F.get("st", F.size("st") - 1), F.lit("")).alias("last_statement"))


TOKENS = {"secret": ["password", "token"], "licence": ["License", "Licence"], "table": [" | "], "shout": ["!!"]}


@query("with d as (select source, text from documents), r(rule, token) as (values " + ", ".join(f"('{k}', '{t}')" for k, v in TOKENS.items() for t in v) + """),
l as (select source, unnest(string_split(coalesce(text, ''), chr(10))) as line from d),
h as (select source, rule, line, bool_or(contains(line, token)) as hit from (select row_number() over () as n, source, line from l), r group by n, source, rule, line)
select source, rule, count(*)::bigint as findings from h where hit group by source, rule""")
def token_rule_findings(spark, sf_dir):
    line = table(spark, sf_dir, "documents").select("source", F.explode(T.lines(F.coalesce("text", F.lit("")))).alias("line"))
    alerts = F.filter(F.array(*[F.when(T.any_token(F.col("line"), v), F.lit(k)) for k, v in TOKENS.items()]), lambda x: x.isNotNull())
    return line.select("source", F.explode(alerts).alias("rule")).groupBy("source", "rule").agg(F.count("*").alias("findings"))


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents)
select doc_id, string_agg(n, ',' order by n) as line_numbers, min(n)::bigint as line_number from l where contains(line, 'password') or contains(line, 'token') group by doc_id""")
def line_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(T.any_token(F.col("text"), ["password", "token"]))
    found = F.filter(F.transform(T.lines(F.col("text")), lambda x, i: F.when(T.any_token(x, ["password", "token"]), i + 1)), lambda x: x.isNotNull())
    return docs.select("doc_id", F.array_join(found.cast("array<string>"), ",").alias("line_numbers"), F.array_min(found).cast("long").alias("line_number"))


@query("select doc_id, item_id, (instr(d.text, b.text))::bigint as at from documents d join benchmark b on contains(d.text, b.text)")
def evidence_contains_join(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return keyed.contains_join(docs, "text", bench, "item", ["doc_id"], ["item_id"]).select("doc_id", "item_id", F.expr("cast(instr(text, item) as bigint)").alias("at"))


SKIP = ["if", "for", "while", "switch", "return", "sizeof", "function"]
_SQL_CALLS = "list_filter(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)[ \\t\\n\\r]*\\(', 1), lambda x: x not in (" + ", ".join(f"'{s}'" for s in SKIP) + "))"


@query(f"select page_id, coalesce(array_to_string(list_sort(list_distinct({_SQL_CALLS})), ','), '') as calls, len(list_distinct({_SQL_CALLS}))::bigint as n_calls from pages")
def call_tokens(spark, sf_dir):
    calls = T.call_tokens(F.coalesce("html", F.lit("")), SKIP)
    return table(spark, sf_dir, "pages").select("page_id", calls.alias("c")).select("page_id", F.array_join(F.array_sort("c"), ",").alias("calls"), F.size("c").cast("long").alias("n_calls"))


@query(f"""with h as (select p_partkey, replace(p_type || ' ' || p_name || ' if', ' ', ' (') || '(' as html from part), c as (select p_partkey, unnest({_SQL_CALLS}) as callee from h)
select callee, min(p_partkey) as first_caller, count(distinct p_partkey)::bigint as callers, left(sha256(callee), 12) as edge_id from c group by callee""")
def call_edges(spark, sf_dir):
    code = F.concat(F.replace(F.concat("p_type", F.lit(" "), "p_name", F.lit(" if")), F.lit(" "), F.lit(" (")), F.lit("("))
    edges = table(spark, sf_dir, "part").select("p_partkey", F.explode(T.call_tokens(code, SKIP)).alias("callee"))
    return edges.groupBy("callee").agg(F.min("p_partkey").alias("first_caller"), F.count_distinct("p_partkey").alias("callers")).withColumn("edge_id", T.short_digest(F.col("callee"), 12))


@query("""with p as (select page_id, repeat('{a', (page_id % 7)::int) || coalesce(html, '') || repeat('}', (page_id % 5)::int) as t from pages), c as (select page_id, unnest(range(1, length(t) + 1)) as pos, unnest(string_split(t, '')) as ch from p),
m as (select page_id, pos, ch, sum(case ch when '{' then 1 else -1 end) over (partition by page_id order by pos) as total from c where ch in ('{', '}')),
o as (select page_id, min(pos) as o from m where ch = '{' group by page_id),
l as (select m.page_id, pos, o, total - least(0, min(total) over (partition by m.page_id order by pos)) as level from m join o on o.page_id = m.page_id),
e as (select page_id, o, min(pos) filter (level = 0 and pos > o) as z from l group by page_id, o)
select p.page_id, coalesce(case when z is null then substr(t, o + 1) else substr(t, o + 1, z - o - 1) end, '') as body from p left join e using (page_id)""")
def brace_bodies(spark, sf_dir):
    """What the first brace of pages, inside up to six more, encloses, with all that is nested in it."""
    text = F.expr("repeat('{a', int(page_id % 7)) || coalesce(html, '') || repeat('}', int(page_id % 5))")
    return table(spark, sf_dir, "pages").select("page_id", T.first_braces(text).alias("body"))


@query("""with f as (select event_id, user_id, event_type, bool_or(event_type = 'signup') over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding) as seen from events)
select event_id, user_id from f where event_type = 'error' and not coalesce(seen, false)""")
def lookback_guard(spark, sf_dir):
    seen = frames.frame_flag(F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"], -3, -1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").withColumn("seen", seen).where("event_type = 'error' and not seen").select("event_id", "user_id")


FRAMES = {"lock": ("signup", -2, 0), "loop": ("view", -5, -1), "budget": ("purchase", -5, 2), "reject": ("error", -1, 5), "proof": ("click", -6, 6), "layout": ("view", 0, 3)}


def _sql_frames() -> str:
    side = lambda n: "current row" if n == 0 else f"{abs(n)} {'preceding' if n < 0 else 'following'}"
    cols = ", ".join(f"coalesce(bool_or(event_type = '{t}') over (partition by user_id order by ts, event_id rows between {side(a)} and {side(b)}), false) as {k}" for k, (t, a, b) in FRAMES.items())
    return f"select event_type, {', '.join(f'count_if({k})::bigint as n_{k}' for k in FRAMES)} from (select event_type, {cols} from events) group by event_type"


@query(_sql_frames())
def frames_all(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", *[frames.frame_flag(F.col("event_type") == t, ["user_id"], ["ts", "event_id"], a, b).alias(k) for k, (t, a, b) in FRAMES.items()])
    return df.groupBy("event_type").agg(*[F.count_if(k).alias(f"n_{k}") for k in FRAMES])


@query("""with n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
p as (select user_id, min(i) filter (event_type = 'view') as v, min(i) filter (event_type = 'purchase') as b from n group by user_id)
select user_id, case when b is null then 'never' when v is null or b < v then 'unchecked' else 'checked' end as verdict from p""")
def order_check(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id").withColumn("i", frames.ordinal(["user_id"], ["ts", "event_id"]))
    p = frames.first_positions(df, ["user_id"], "i", {"v": F.col("event_type") == "view", "b": F.col("event_type") == "purchase"})
    return p.select("user_id", F.when(F.col("b").isNull(), "never").when(F.col("v").isNull() | (F.col("b") < F.col("v")), "unchecked").otherwise("checked").alias("verdict"))


@query("""with k as (select user_id, event_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next_type from events where event_type in ('signup', 'click', 'purchase'))
select event_id, user_id, next_type from k where event_type = 'signup' and next_type in ('signup', 'purchase')""")
def release_then_use(spark, sf_dir):
    df = frames.next_event(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", ["signup", "click", "purchase"], "next_type")
    return df.where("event_type = 'signup' and next_type in ('signup', 'purchase')").select("event_id", "user_id", "next_type")


@query("""with n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)
select g.event_id as guard_id, r.event_id as return_id from n g join n r on g.user_id = r.user_id and r.i between g.i and g.i + 2 where g.event_type = 'signup' and r.event_type = 'error'""")
def guard_return_range(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts").withColumn("i", frames.ordinal(["user_id"], ["ts", "event_id"]))
    left = df.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("guard_id"), "i")
    right = df.where("event_type = 'error'").select("user_id", "i", F.col("event_id").alias("return_id"))
    return frames.within_rows(left, right, ["user_id"], "i", 2).select("guard_id", "return_id")


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents),
w as (select doc_id, n, string_agg(line, chr(10)) over (partition by doc_id order by n rows between 2 preceding and current row) as t from l)
select doc_id, count(*)::bigint as near from w where contains(t, 'License') group by doc_id""")
def line_window_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License"))).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line"))
    joined = frames.frame_text("line", ["doc_id"], ["n"], -2, 0)
    return docs.withColumn("t", joined).where(F.contains("t", F.lit("License"))).groupBy("doc_id").agg(F.count("*").alias("near"))


@query("""with a as (select o_custkey, o_orderpriority, max(o_orderkey) as in_a from orders where o_orderstatus in ('F', 'O') group by all), b as (select o_custkey, o_orderpriority, max(o_orderkey) as in_b from orders where o_orderstatus in ('O', 'P') group by all)
select coalesce(a.o_custkey, b.o_custkey) as o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) as o_orderpriority, case when in_a is null then 'added' when in_b is null then 'removed' else 'unchanged' end as change, in_a, in_b
from a full join b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority""")
def diff_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return keyed.diff(o.where("o_orderstatus in ('F', 'O')"), o.where("o_orderstatus in ('O', 'P')"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("select sha256(text) as sha256, min(doc_id) as first_doc, min_by(source, doc_id) as source, count(*)::bigint as copies, min(strlen(text))::bigint as size_bytes from documents where length(text) > 0 group by sha256(text)")
def ingest_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "source", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.min_by("source", "doc_id").alias("source"), F.count("*").alias("copies"), F.min("n").alias("size_bytes"))


@query("select source, sha256(string_agg(x, '' order by x)) as digest, count(*)::bigint as members from (select source, doc_id::varchar || chr(0) || sha256(coalesce(text, '')) as x from documents) group by source")
def bundle_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(keyed.set_digest(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("digest"), F.count("*").alias("members"))


@query("select o_orderkey, o_orderstatus from orders order by o_orderdate desc, o_orderkey desc limit 50")
def artifact_list(spark, sf_dir):
    return keyed.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderstatus")


@query("with d as (select *, case when o_orderpriority = '5-LOW' then o_orderdate end as deleted_at from orders) select o_orderkey, o_custkey from d where deleted_at is null order by o_orderdate desc, o_orderkey desc limit 100")
def scan_history(spark, sf_dir):
    gone = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"))
    return keyed.newest(table(spark, sf_dir, "orders").withColumn("deleted_at", gone).where("deleted_at is null"), "o_orderdate", "o_orderkey", 100).select("o_orderkey", "o_custkey")


@query("""select l_orderkey, l_linenumber, o_orderstatus, o_orderpriority from lineitem left join orders on l_orderkey = o_orderkey""")
def scan_artifact_join(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return l.join(o, l.l_orderkey == o.o_orderkey, "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "o_orderpriority")


@query("select c_custkey, n_name, row_number() over (partition by n_name order by lower(c_name), c_custkey)::int as place from customer left join nation on c_nationkey = n_nationkey")
def lookup_sort(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return joined.select("c_custkey", "n_name", F.row_number().over(Window.partitionBy("n_name").orderBy(F.lower("c_name"), "c_custkey")).alias("place"))


@query("""with w as (select distinct o_orderpriority as name from orders union select n_name from nation union select distinct p_brand from part union select distinct c_mktsegment from customer),
c as (select n_name as name, 1 as prio, 'function:' || n_nationkey as id from nation union all select r_name, 2, 'type:' || r_regionkey from region union all select distinct p_brand, 3, 'state:' || p_brand from part)
select w.name, coalesce(min_by(c.id, c.prio), 'external:' || w.name) as id, coalesce(min(c.prio), 9)::int as prio from w left join c on w.name = c.name group by w.name""")
def endpoint_resolution(spark, sf_dir):
    n, r, p, o, c = (table(spark, sf_dir, x) for x in ("nation", "region", "part", "orders", "customer"))
    wanted = o.select(F.col("o_orderpriority").alias("name")).union(n.select("n_name")).union(p.select("p_brand")).union(c.select("c_mktsegment")).distinct()
    known = n.select(F.col("n_name").alias("name"), F.lit(1).alias("prio"), F.concat(F.lit("function:"), "n_nationkey").alias("id"))
    known = known.union(r.select("r_name", F.lit(2), F.concat(F.lit("type:"), "r_regionkey"))).union(p.select("p_brand", F.lit(3), F.concat(F.lit("state:"), "p_brand")).distinct())
    return graph.resolve(wanted, known, "name")


_SQL_CLASS = "case when starts_with(url, 'https://m.') or starts_with(url, 'http://m.') then 'mobile' when contains(url, '.example.org') then 'library' when contains(url, 'blog.') then 'pointer' else 'symbol' end"


@query(f"select page_id, {_SQL_CLASS} as class, regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9_]', '_', 'g') as token from pages")
def external_class(spark, sf_dir):
    u = F.col("url")
    cls = F.when(F.startswith(u, F.lit("https://m.")) | F.startswith(u, F.lit("http://m.")), "mobile").when(F.contains(u, F.lit(".example.org")), "library").when(F.contains(u, F.lit("blog.")), "pointer").otherwise("symbol")
    return table(spark, sf_dir, "pages").select("page_id", cls.alias("class"), T.safe_token(T.basename(u)).alias("token"))


@query("select page_id, n::bigint as n from (select page_id, unnest(regexp_extract_all(url, '[0-9]+')) as n from pages) where n::bigint <> 2")
def captured_constants(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[0-9]+"), 0)).alias("n")).select("page_id", F.col("n").cast("long").alias("n")).where("n <> 2")


@query("""select l_orderkey, l_linenumber, unnest(list_filter([case when l_discount > 0.05 and l_tax > 0.05 then 'mul-div' end, case when l_discount > 0.05 then 'div' end, case when l_quantity > 45 then 'math' end], lambda x: x is not null)) as alert from lineitem""")
def multi_alert_explode(spark, sf_dir):
    alerts = F.array(F.when((F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.05), "mul-div"), F.when(F.col("l_discount") > 0.05, "div"), F.when(F.col("l_quantity") > 45, "math"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.filter(alerts, lambda x: x.isNotNull())).alias("alert"))


REQUIRED = ["the", "der", "que", "and", "une"]


@query(f"""select doc_id, array_to_string(list_sort([x for x in {REQUIRED} if not list_contains(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), x)]), ',') as missing from documents""")
def required_minus_present(spark, sf_dir):
    present = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), present)), ",").alias("missing"))


@query("select user_id, event_id // 1000 as part from events group by all having bool_or(event_type = 'signup') and not bool_or(event_type = 'purchase')")
def stake_without_unstake(spark, sf_dir):
    part = F.expr("event_id div 1000").alias("part")
    e = table(spark, sf_dir, "events").groupBy("user_id", part).agg(F.bool_or(F.col("event_type") == "signup").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    return e.where("a and not b").select("user_id", "part")


@query("select user_id, bool_or(event_type = 'view') as calls_internal, bool_or(event_type = 'error') as calls_system, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by user_id")
def outgoing_flags(spark, sf_dir):
    return graph.outgoing(table(spark, sf_dir, "events"), "user_id", "event_type", {"calls_internal": "view", "calls_system": "error"})


@query("""with e as (select l_suppkey, l_partkey, min(struct_pack(o := l_orderkey, n := l_linenumber)) as f from lineitem group by all)
select 'supplier:' || l_suppkey as source, 'part:' || l_partkey as target, left(sha256('supplier:' || l_suppkey || '>' || 'part:' || l_partkey), 12) as id, f.o as first_order from e
where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) and l_partkey in (select p_partkey from part where p_size > 10)""")
def graph_nodes_edges(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id")).union(table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("part:"), "p_partkey")))
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier:"), "l_suppkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target"), "l_orderkey", "l_linenumber")
    edges = keyed.first_wins(edges, ["source", "target"], ["l_orderkey", "l_linenumber"], "l_orderkey")
    return graph.drop_dangling(nodes, edges).select("source", "target", T.short_digest(F.concat("source", F.lit(">"), "target"), 12).alias("id"), F.col("l_orderkey").alias("first_order"))


@query("""with l as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem)
select o_orderkey, coalesce(string_agg(l_partkey, '>' order by n), '') as paths from orders left join (select * from l where n <= 3) on l_orderkey = o_orderkey group by o_orderkey""")
def write_paths(spark, sf_dir):
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey.cast("string")), 1, 3)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(first, ">").alias("paths"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", F.coalesce("paths", F.lit("")).alias("paths"))


@query("select event_type, case event_type when 'error' then '#c62828' when 'signup' then '#2e7d32' else '#' || left(sha256(event_type), 6) end as color, count(*)::bigint as n from events group by event_type")
def modifier_colors(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.select("event_type", graph.color(F.col("event_type"), {"error": "#c62828", "signup": "#2e7d32"}).alias("color"), "n")


@query("select event_type, sum((props->>'$.k')::bigint)::bigint as total, count(props->>'$.k')::bigint as n from events group by event_type")
def payload_json(spark, sf_dir):
    k = F.from_json("props", "k long").getField("k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


@query("select coalesce(source, 'all') as source, count(*)::bigint as docs, sum(n_chars)::bigint as chars, count(distinct lang)::bigint as langs from documents group by grouping sets ((source), ())")
def model_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.collect_set("lang").alias("l"))
    whole = d.agg(F.lit("all").alias("source"), F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), F.size(F.array_distinct(F.flatten(F.collect_list("l")))).cast("long").alias("langs"))
    return d.select("source", "docs", "chars", F.size("l").cast("long").alias("langs")).unionByName(whole)


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents),
h as (select doc_id, n, row_number() over (partition by doc_id order by n) as k from l where contains(line, 'the'))
select doc_id, n::int as line_number from h where k <= 6""")
def caps_per_file(spark, sf_dir):
    hits = F.slice(F.filter(F.transform(T.lines(F.col("text")), lambda x, i: F.when(F.contains(x, F.lit("the")), i + 1)), lambda x: x.isNotNull()), 1, 6)
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", F.explode(hits).alias("line_number"))


_SQL_STATUS = "case when coalesce(strlen(html), 0) = 0 then 'empty_file' when lower(regexp_extract(string_split(url, '/')[-1], '[^.](\\.[^.]+)$', 1)) <> '.html' then 'unsupported_extension' when strlen(html) > 4096 then 'too_large' else 'ok' end"


@query(f"select {_SQL_STATUS} as status, count(*)::bigint as n from pages group by 1")
def upload_validity(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(upload_status(F.col("html"), F.col("url"), [".html"], 4096).alias("status")).agg(F.count("*").alias("n"))


def upload_status(content, name, extensions, most):
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size == 0, "empty_file").when(~T.extension(name).isin(extensions), "unsupported_extension").when(size > most, "too_large").otherwise("ok")


@query("select doc_id, least(nullif(instr(text, ' for '), 0), nullif(instr(text, ' und '), 0))::int as first_loop from documents")
def min_position(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("least(nullif(instr(text, ' for '), 0), nullif(instr(text, ' und '), 0))").alias("first_loop"))


@query("""select p_partkey, case when n = 1 then 'inc:' || p_brand else 'inc:' || p_brand || '~' || left(sha256(p_name), 8) end as id
from (select p_partkey, p_brand, p_name, row_number() over (partition by p_brand order by p_partkey) as n from part)""")
def disambiguated_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    # the first of each brand by a partial aggregation, so no brand is sorted in one task
    first = parts.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("first"))
    base = F.concat(F.lit("inc:"), "p_brand")
    rest = F.concat(base, F.lit("~"), T.short_digest(F.col("p_name"), 8))
    return parts.join(first, F.col("p_brand").eqNullSafe(F.col("brand"))).select("p_partkey", F.when(F.col("p_partkey") == F.col("first"), base).otherwise(rest).alias("id"))


@query("select role, count(*)::bigint as turns, count(distinct conv_id)::bigint as conversations, sum(case when prev = role then 1 else 0 end)::bigint as same_as_before from (select *, lag(role) over (partition by conv_id order by turn) as prev from conversations) group by role")
def turn_order(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev"))
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.when(F.col("prev") == F.col("role"), 1).otherwise(0)).alias("same_as_before"))
