"""Secret scan with multipart credential linking, in built-in functions only.

Base kinds are strong alone: ``assign`` (a secret-like name is given a value of six characters or more), ``access``
(an access key identifier) and ``hex`` (24 or more hexadecimal digits). Weak kinds are candidates that prove nothing
alone: ``id`` (a named user, client or account, or a temporary key identifier), ``key`` (a mixed run of 32 or more
base64 characters) and ``endpoint`` (a URL). A span interval-joins those within SCOPE code points of it, and a weak
span is reported only when complementary parts co-occur there:

* ``id``: a base secret (assign or hex), or both a ``key`` and an ``endpoint``;
* ``key``: a base identifier (access), or both an ``id`` and an ``endpoint``;
* ``endpoint``: an identifier (access or id) and a secret (assign, hex or key).

Weak spans that overlap a base span are left out; base spans always stay. Everything is computed inside the row, so
nothing is shuffled and texts of any length are scanned whole. Positions count code points, ends are exclusive; they
come from the lengths of what lies between the matches.

Defined cases: a null text is empty; texts without findings give zero counts, the hash of the empty string and empty
spans. Repeated rows give a row each, null ids pass through, other columns are ignored (``redact_secrets`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Code points between spans of one credential.
SCOPE = 400

# letters in either case, spelled out: engines differ in what else they fold
_NAME = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_OWNER = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("client", "account", "user", "app"))
#: kind, pattern, a cheap test that must hold, a test of the match (m) or its second group (g)
KINDS = (
    ("assign", rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "contains(text, ':') or contains(text, '=')", "length(g) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "contains(text, 'AKIA')", "length(m) >= 20"),
    ("hex", r"[0-9a-f]{24,}", "true", "true"),
    ("id", rf"""(?:A(?:SIA|IDA|ROA)[A-Z0-9]{{12,}}|(?:{_OWNER})_?(?:[Ii][Dd]|[Nn][Aa][Mm][Ee])?["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{4,}})""", "contains(text, ':') or contains(text, '=') or contains(text, 'ASIA') or contains(text, 'AIDA') or contains(text, 'AROA')", "true"),
    ("key", r"[A-Za-z0-9+/]{32,}", "true", "m rlike '[0-9]' and m rlike '[a-z]' and m rlike '[A-Z]'"),
    ("endpoint", r"""[a-z][a-z0-9+]{1,9}://[^\x20\x09-\x0D"'<>]+""", "contains(text, '://')", "true"),
)
BASE, WEAK = ("assign", "access", "hex"), ("id", "key", "endpoint")


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


#: Matches whose lengths are added up at once; so starts cost about the same for each match, however many there are.
RUN = 256


def _last(spans: str, limit: str) -> str:
    """How many of the spans, which ascend, start at or before the limit: a search by halves."""
    step = "lo + shiftleft(1, k)"
    found = f"aggregate(sequence(length(bin(size({spans}))) - 1, 0, -1), 0, (lo, k) -> if({step} <= size({spans}) and get({spans}, {step} - 1).start <= {limit}, {step}, lo))"
    return f"if(size({spans}) = 0, 0, {found})"


def _meets(spans: str, reach: int) -> str:
    """Whether a span of one kind, which never overlap each other, lies within reach of x: the last that begins in time ends last."""
    return f"coalesce(get({spans}, {_last(spans, f'x.end + {reach}')} - 1).end >= x.start - {reach}, false)"


def _near(*kinds: str) -> str:
    return "(" + " or ".join(_meets(f"_{'s' if k in BASE else 'w'}_{k}", SCOPE) for k in kinds) + ")"


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns row (docs as a struct, so that no name clashes), _text, and _base and _spans: arrays of (start, rank, end, kind) by start, then rank."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind, pattern, cheap, _ in KINDS:
        df = df.withColumn(f"_m_{kind}", F.expr(f"if({cheap.replace('text', '_text')}, regexp_extract_all(_text, {_literal(pattern)}, 0), cast(array() as array<string>))"))
    for rank, (kind, pattern, _, test) in enumerate(KINDS):
        m = f"_m_{kind}"
        second = f"regexp_extract_all(_text, {_literal(pattern)}, 2)" if kind == "assign" else "cast(array() as array<string>)"
        # what lies before, between and after the matches
        df = df.withColumn(f"_p_{kind}", F.expr(f"if(size({m}) > 0, split(_text, {_literal(pattern)}, -1), cast(array() as array<string>))"))
        df = df.withColumn(f"_g_{kind}", F.expr(f"if(size({m}) > 0, {second}, cast(array() as array<string>))"))
        # starts inside runs of matches, then the runs one after the other
        steps = f"zip_with(slice(_p_{kind}, b * {RUN} + 1, {RUN}), slice({m}, b * {RUN} + 1, {RUN}), (p, q) -> if(q is null, null, struct(length(p) as gap, length(q) as n)))"
        run = f"aggregate(filter({steps}, z -> z is not null), struct(0 as at, cast(array() as array<struct<start:int,n:int>>) as starts), (a, z) -> struct(a.at + z.gap + z.n as at, array_append(a.starts, struct(a.at + z.gap as start, z.n as n)) as starts))"
        df = df.withColumn(f"_r_{kind}", F.expr(f"if(size({m}) > 0, transform(sequence(0, (size({m}) - 1) div {RUN}), b -> {run}), null)"))
        runs = f"transform(_r_{kind}, (r, b) -> struct(r.starts as starts, aggregate(slice(_r_{kind}, 1, b), 0, (a, z) -> a + z.at) as at))"
        ok = test.replace("length(g)", f"length(_g_{kind}[i])").replace("length(m)", f"length({m}[i])").replace("m rlike", f"{m}[i] rlike")
        spans = f"flatten(transform({runs}, r -> transform(r.starts, z -> struct(r.at + z.start as start, {rank} as rank, r.at + z.start + z.n as end, '{kind}' as kind))))"
        df = df.withColumn(f"_s_{kind}", F.expr(f"if(size({m}) > 0, filter({spans}, (z, i) -> {ok}), cast(array() as array<{_SPAN}>))"))
    df = df.withColumn("_base", F.expr("array_sort(concat(_s_assign, _s_access, _s_hex))"))
    for kind in WEAK:
        inside = " or ".join(_meets(f"_s_{k}", -1) for k in BASE)
        df = df.withColumn(f"_w_{kind}", F.expr(f"filter(_s_{kind}, x -> not ({inside}))"))
    told = (
        f"(x.kind = 'id' and ({_near('assign', 'hex')} or ({_near('key')} and {_near('endpoint')})))"
        f" or (x.kind = 'key' and ({_near('access')} or ({_near('id')} and {_near('endpoint')})))"
        f" or (x.kind = 'endpoint' and {_near('access', 'id')} and {_near('assign', 'hex', 'key')})"
    )
    df = df.withColumn("_weak", F.expr("concat(_w_id, _w_key, _w_endpoint)"))
    df = df.withColumn("_spans", F.expr(f"if(size(_weak) > 0, array_sort(concat(_base, filter(_weak, x -> {told}))), _base)"))
    return df.select("row", "_text", "_base", "_spans")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = with_spans(docs.select("doc_id", "text"))
    count = [F.expr(f"cast(size(filter(_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *count, F.sha2(F.expr(_joined("_base")), 256).alias("base_sha256"), F.expr(_joined("_spans")).alias("spans"))


MASK = "[SECRET]"


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every reported span, or run of spans that overlap, of the text replaced by MASK; other columns unchanged."""
    found = with_spans(docs)
    # each span keeps what lies past the furthest end before it
    step = f"struct(concat(a.out, if(x.start >= a.at, concat(substring(_text, a.at + 1, x.start - a.at), '{MASK}'), '')) as out, greatest(a.at, x.end) as at)"
    whole = f"aggregate(_spans, struct('' as out, 0 as at), (a, x) -> {step}, a -> concat(a.out, substring(_text, a.at + 1)))"
    redacted = F.expr(f"if(size(_spans) > 0, {whole}, row.text)").alias("text")
    return found.select(*[redacted if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _duck(kind: str, pattern: str, test: str, rank: int) -> str:
    q = "'" + pattern.replace("'", "''") + "'"
    ok = test.replace("length(g)", f"length(g_{kind}[i])").replace("length(m)", f"length(m_{kind}[i])")
    for c in ("[0-9]", "[a-z]", "[A-Z]"):
        ok = ok.replace(f"m rlike '{c}'", f"regexp_matches(m_{kind}[i], '{c}')")
    start = f"(coalesce(list_sum([length(s) for s in p_{kind}[1:i]]), 0) + coalesce(list_sum([length(s) for s in m_{kind}[1:i - 1]]), 0))"
    return f"[{{'start': {start}::int, 'rank': {rank}, 'end': ({start} + length(m_{kind}[i]))::int, 'kind': '{kind}'}} for i in range(1, len(m_{kind}) + 1) if {ok}] as s_{kind}"


def oracle() -> str:
    """The same rows from DuckDB."""
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p, _, _ in KINDS}
    m = ", ".join(f"regexp_extract_all(t, {quoted[k]}) as m_{k}, string_split_regex(t, {quoted[k]}) as p_{k}" for k, *_ in KINDS)
    spans = ", ".join(_duck(k, p, test, r) for r, (k, p, _, test) in enumerate(KINDS))

    def near(where: str, *kinds: str) -> str:
        named = ", ".join(f"'{k}'" for k in kinds)
        return f"len([y for y in {where} if y.kind in ({named}) and y.start - x.end <= {SCOPE} and x.start - y.end <= {SCOPE}]) > 0"

    told = (
        f"(x.kind = 'id' and ({near('base', 'assign', 'hex')} or ({near('weak', 'key')} and {near('weak', 'endpoint')})))"
        f" or (x.kind = 'key' and ({near('base', 'access')} or ({near('weak', 'id')} and {near('weak', 'endpoint')})))"
        f" or (x.kind = 'endpoint' and ({near('base', 'access')} or {near('weak', 'id')}) and ({near('base', 'assign', 'hex')} or {near('weak', 'key')}))"
    )
    text = lambda s: f"array_to_string([x.kind || ':' || x.start || ':' || x.end for x in {s}], ',')"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
a as (select doc_id, {m}, regexp_extract_all(t, {quoted['assign']}, 2) as g_assign from d),
b as (select doc_id, {spans} from a),
c as (select doc_id, list_sort(s_assign || s_access || s_hex) as base, s_id || s_key || s_endpoint as w from b),
e as (select doc_id, base, [x for x in w if len([y for y in base if y.start < x.end and x.start < y.end]) = 0] as weak from c),
f as (select doc_id, base, list_sort(base || [x for x in weak if {told}]) as spans from e)
select doc_id, {', '.join(f"len([x for x in base if x.kind = '{k}'])::bigint as n_{k}" for k in BASE)},
  sha256({text('base')}) as base_sha256, coalesce({text('spans')}, '') as spans from f"""
