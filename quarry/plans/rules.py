"""Rules one by one over the sources derived from suppliers, each with its SQL.

The rules read files through the parsers; the SQL knows the functions of a file from how it was put together and reads no
parser's output. It shares word lists and patterns with the rules and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import adapters, c_rules as _R, rust_rules as R, solidity_rules as S
from quarry.plans.models import literal
from quarry.sources import code, derived
from quarry.sources.facts import Facts

QUERIES: dict = {}
SQL: dict[str, str] = {}

_OUT = ("path", "function_name", "idx", "detail", "statement")


def _add(task: str, kind: str, run, sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(derived.sources(spark, sf_dir, kind)).where(F.col("task_id") == task).select(*_OUT)

    query.__name__ = f"rule_{task}"
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = f"with {derived.sql(kind)}, {sql}"


def _pieces(text: str, longer_than: int, cut: str = ";") -> str:
    """The statements of a body between separators, in order."""
    collapsed = f"list_transform(regexp_split_to_array({text}, '{cut}'), lambda x: trim(regexp_replace(x, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')))"
    return f"list_filter({collapsed}, lambda x: length(x) > {longer_than})"


# --- C ------------------------------------------------------------------------------------------------------------------


def _any(c: str, tokens: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {literal(t)})" for t in tokens) + ")"


def _re(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {literal(pattern)})"


def _near(flag: str, low: int, high: int) -> str:
    side = lambda n: "current row" if n == 0 else f"{abs(n)} {'preceding' if n < 0 else 'following'}"
    return f"coalesce(bool_or({flag}) over (partition by path, fn order by idx rows between {side(low)} and {side(high)}), false)"


_BARE = "regexp_extract(s, '^(\\w+)\\s*\\(', 1)"
_MASK = "regexp_extract(s, '\\b(\\w+)\\s*&\\s*(?:0x1|1)(?:\\D|$)', 1)"
_RING = "trim(regexp_extract(s, '\\bio_uring_submit\\s*\\(\\s*([^),]*)', 1))"
_IN = lambda c, xs: f"{c} in ({', '.join(map(literal, xs))})"
#: task: condition on a statement s (low: in small letters), detail (a list gives a row for each element)
CONDITIONS = {
    "102": (f"{_re('s', '<<|>>')} and {_re('s', _R.OUTSIDE_POINTER)} and not {_any('s', _R.SHIFT_BOUNDS)} and not {_near(_any('s', _R.SHIFT_BOUNDS), -3, -1)}", "['']"),
    "103": (f"{_any('s', _R.CRITICAL_CALLS)} and not {_re('s', '=' + chr(92) + 's*' + chr(92) + 'w+' + chr(92) + 's*' + chr(92) + '(')} and not ({' or '.join(f'starts_with(s, {literal(g)})' for g in _R.CALL_GUARDS)}) and {_any(_BARE, _R.CRITICAL_CALLS)}", f"[{_BARE}]"),
    "106": (f"{_re('s', '->' + chr(92) + 's*decode' + chr(92) + 's*=')} and {_re('s', _R.DECODE_CAST)}", "['']"),
    "107": (f"{_IN(_MASK, _R.FLAG_FIELDS)} and not {_any('s', _R.FLAG_SAFE)}", f"[{_MASK}]"),
    "108": (f"{_re('s', _R.FRAME_WORK)} and {_near(_re('s', chr(92) + 'b(?:while|for)' + chr(92) + 'b'), -5, -1)} and not {_near(_any('s', _R.FRAME_BUDGET), -5, 2)}", "['']"),
    "109": (f"{_re('s', _R.HANDSHAKE_POOL)} and {_near(_re('s', _R.POOL_FULL), -1, 5)} and not {_near(_any('low', _R.EVICTION), -1, 5)}", "['']"),
    "110": (f"not {_any('s', _R.ATOMICS)}", f"list_filter(regexp_extract_all(s, '(?:->|\\.)(\\w+)\\s*(?:\\+\\+|--)', 1), lambda x: {_IN('x', _R.COUNT_FIELDS)})"),
    "111": (f"{_re('s', chr(92) + 'bio_uring_submit' + chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')')} and not {_any(f'lower({_RING})', _R.RING_PRIVATE)} and not {_near(_any('low', _R.LOCKS), -2, 0)} and ({_any(f'lower({_RING})', _R.RING_SHARED)} or bool_or({_any('low', _R.TILES)}) over (partition by path, fn))", f"[{_RING}]"),
    "112": (_any("s", _R.TABLE_WORDS), f"list_filter(regexp_extract_all(s, '(?:>|>=|<|<=)\\s*(\\d+)\\b', 1), lambda x: x::hugeint <> {_R.TABLE_WINDOW})"),
    "114": (f"{_re('s', _R.AGGREGATE)} and not {_near(_any('s', _R.POSSESSION), -6, 6)}", "['']"),
    "116": (f"{_any('s', _R.SIGNED)} and {_re('s', '[+' + chr(92) + '-*]')} and not {_any('s', _R.OVERFLOW_SAFE)} and {_any('low', _R.CONSENSUS)}", "['']"),
    "118": (f"contains(low, 'struct') and contains(s, '{{') and not contains(low, '__attribute__((packed))') and not contains(low, 'alignas(') and {_near('contains(low, ' + literal('(struct') + ') and ' + _any('low', _R.WIRE), 0, 3)} and not {_near('contains(low, ' + literal('static_assert') + ') and contains(low, ' + literal('sizeof') + ')', 0, 3)}", "['']"),
    "119": (f"{_re('s', '[/%]')} and not {_any('low', _R.ROUNDING_SAFE)} and {_any('low', _R.SIGNED_MATH)} and {_any('low', _R.CONSENSUS)}", "['']"),
    "120": (f"{_any('low', ['vm->mem', 'vm_mem'])} and {_re('s', _R.VM_CAST)} and not {_near(_any('low', _R.ALIGNED), -3, -1)}", "['']"),
}

_C = f"""{derived.functions_sql('c')}, t0 as (select path, i as fn, 'rules.' || name as function_name, {_pieces('body', 2, '[;' + chr(92) + 'n]')} as xs from t),
s as (select path, fn, function_name, generate_subscripts(xs, 1) - 1 as idx, unnest(xs) as s from t0)"""


def _rule_sql(condition: str, detail: str) -> str:
    return f"{_C}, r as (select path, fn, function_name, idx, s, {detail} as details, {condition} as hit from (select *, lower(s) as low from s)) select path, function_name, idx::int as idx, unnest(details) as detail, left(s, 120) as statement from r where hit"


_ORDER = f"""{_C}, k as (select path, fn, function_name, idx, lower(regexp_extract(s, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) as call from s),
p as (select path, function_name, min(idx) filter ({_any('call', _R.UPDATE)}) as u, min(idx) filter ({_any('call', _R.HALT)}) as h, min(idx) filter ({_any('call', _R.FLUSH)}) as f from k group by all)
select path, function_name, u::int as idx, case when h is null or f is null then 'incomplete' else 'order' end as detail, '' as statement from p where u is not null and (h is null or f is null or u < h or u < f)"""
_RETURNS = f"""{_C}, k as (select *, lower(s) as low, regexp_extract(s, '\\breturn\\s+([A-Z_][A-Z0-9_]*)\\b', 1) as code from s)
select r.path, r.function_name, r.idx::int as idx, r.code as detail, left(r.s, 120) as statement from k g join k r on g.path = r.path and g.fn = r.fn and r.idx between g.idx and g.idx + 2
where contains(g.low, 'program') and (contains(g.low, 'id') or contains(g.low, 'exists')) and (contains(g.low, 'if') or contains(g.low, 'switch')) and {_IN('r.code', _R.WRONG_CODES)}"""
#: The derived files nest no deeper than this.
_NEST = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_OPERAND = rf"(?:{_NEST}|\(.*|[A-Za-z_]\w*(?:->[A-Za-z_]\w*)*(?:{_NEST})?)"
_EDGE = "[^A-Za-z0-9_]"
_FLOATS = rf"(?:^|{_EDGE})(?:\d+[eE][+-]?\d+|\d+\.\d*|\d*\.\d+)[fFlL]?(?:{_EDGE}|$)|\b\w*_(?:double|float)\b|^[df]$|(?i:\b(?:double|float)\b)"
_CASTS = f"{_C} select path, function_name, idx::int as idx, '' as detail, left(s, 120) as statement from s where {_re('s', _R.UNSIGNED_CAST)} and not {_any('s', _R.SATURATING)} and len(list_filter(regexp_extract_all(s, {literal(_R.UNSIGNED_CAST + r'\s*(' + _OPERAND + ')')}, 1), lambda o: regexp_matches(trim(o), {literal(_FLOATS)}))) > 0"
_FREED = f"""{_C}, k as (select *, regexp_extract(s, {literal(_R.RELEASE)}, 1) as freed from s),
e as (select a.path, a.fn, a.function_name, a.freed as name, a.idx as began, b.idx, b.s, case when b.freed = a.freed then 'release' when b.freed <> '' then null when regexp_matches(b.s, '\\b' || a.freed || '\\s*=') then 'set' when regexp_matches(b.s, '\\b' || a.freed || '\\s*(?:->|\\[)') or contains(b.s, '*' || a.freed) then 'use' end as event
  from k a join k b on a.path = b.path and a.fn = b.fn and b.idx > a.idx where a.freed <> ''),
d as (select * from e where event is not null qualify row_number() over (partition by path, fn, began, name order by idx) = 1)
select path, function_name, idx::int as idx, name as detail, left(s, 120) as statement from d where event = 'use'"""
_EFFECTS = f"""{_C}, n as (select path, fn, function_name, idx, s, string_split(regexp_extract(s, '\\((.*)\\)', 1), '') as cs from s),
h as (select path, fn, function_name, idx, s, generate_subscripts(cs, 1) as i, unnest(cs) as ch from n where list_contains(cs, ',')),
d as (select *, sum(case ch when '(' then 1 when ')' then -1 else 0 end) over (partition by path, fn, idx order by i) as depth from h),
g as (select *, count(*) filter (ch = ',' and depth = 0) over (partition by path, fn, idx order by i) as arg from d),
a as (select path, fn, function_name, idx, s, arg, coalesce(string_agg(ch, '' order by i) filter (not (ch = ',' and depth = 0)), '') as text from g group by all),
u as (select path, function_name, idx, s, count(*) as n from a where {_any("lower(regexp_extract(text, '" + chr(92) + "b([A-Za-z_]" + chr(92) + "w*)" + chr(92) + "s*" + chr(92) + "(', 1))", _R.EFFECTS)} group by path, fn, function_name, idx, s)
select path, function_name, idx::int as idx, '' as detail, left(s, 120) as statement from u where n >= 2"""
_KEYS = f"select f.path, '' as function_name, (-1)::int as idx, r.k as detail, '' as statement from f, (select unnest({literal(_R.RESERVED_KEYS)}) as k) r where not contains(content, chr(34) || r.k || chr(34))"


def _statements(sources: DataFrame) -> DataFrame:
    return code.statements_of(Facts(sources.sparkSession).functions(sources))


for _task, (_condition, _detail) in CONDITIONS.items():
    _add(_task, "c", lambda src, t=_task: _R.statement_alerts(_statements(src), t), _rule_sql(_condition, _detail))
for _task, _run, _select in (("101", lambda s: _R.statement_alerts(s, "101"), _CASTS), ("104", _R.released_then_used, _FREED), ("113", _R.switch_order, _ORDER), ("115", _R.guarded_returns, _RETURNS), ("117", lambda s: _R.statement_alerts(s, "117"), _EFFECTS)):
    _add(_task, "c", lambda src, f=_run: f(_statements(src)), _select)
_add("105", "registry", _R.missing_keys, _KEYS)

# --- Rust: public functions ---------------------------------------------------------------------------------------------

_FACTS = f"""{derived.functions_sql('contract')}, s as (select *, {_re('content', r'#\s*\[\s*contractimpl\b')} as contract, lower(body) as low,
  lower(array_to_string(list_transform({_pieces('body', 2)}, lambda x: x || ';'), ';')) as u from t),
w as (select *, contract and visibility = 'external' as entry, contains(u, '.set(') as sets,
  {_re('u', r'\.instance\s*\([^)]*\)\s*\.(?:set|replace|append|extend_ttl)')} or (contains(u, '.instance()') and contains(u, '.set(')) as inst,
  contains(u, '.persistent()') and contains(u, '.set(') as pers, contains(u, '.temporary()') and contains(u, '.set(') as temp,
  strpos(content, nullif(regexp_extract(content, '\\bpub\\s*(?:\\([^)]*\\)\\s*)?fn\\s+' || name || '\\s*\\('), '')) as pos,
  least(nullif(strpos(body, 'for '), 0), nullif(strpos(body, 'while '), 0)) as loop_at from s),
v as (select *, inst or pers or temp as mutates, case when pos > 1 then substr(content, greatest(pos - 500, 1)::int, least(pos - 1, 500)::int) else '' end as ahead from w)
select path, 'lib.' || name as function_name, 0::int as idx, '' as detail, '' as statement from v where """

_FUNCTION_RULES = {
    "201": f"entry and mutates and not {_re('u', r'\.require_auth\s*\(|require_auth_for_args\s*\(')}",
    "202": f"inst and {_re('signature || chr(10) || body', R.DYNAMIC)}",
    "203": f"""{_re("replace(replace(body, ' ', ''), 'try_invoke_contract', '')", r'invoke_contract\s*\(')} and not contains(replace(u, ' ', ''), 'try_invoke_contract')""",
    "204": f"entry and {_re('signature', r'\bVec\s*<|\bMap\s*<')} and not {_re('body', r'\.len\s*\(\s*\)\s*<=')}",
    "205": "not temp and (inst or pers) and not contains(low, 'extend_ttl')",
    "206": _re("u", r"\bpanic\s*!\s*\(|\b(?:assert|debug_assert)\s*!\s*\("),
    "207": f"{_any('u', ['for ', '.iter()', ' while '])} and contains(u, '.storage()') and {_any('u', ['.get(', '.has('])}",
    "208": f"starts_with(name, '__constructor') and mutates and not {_any('low', ['has(', 'get('])}",
    "212": f"visibility in ('external', 'crate') and {_re('body', R.PANICS)} and not {_re('ahead', R.CFG_TEST_ATTRIBUTE)}",
    "213": f"{_re('body', r'\b(?:Arc|Rc)\s*(?:<|::)')} and coalesce(contains(substr(body, loop_at), '.clone()'), false)",
}


def _rust_functions(task: str):
    return lambda src: R.function_alerts(R.with_facts(Facts(src.sparkSession).functions(src), src), task)


for _task, _where in _FUNCTION_RULES.items():
    _add(_task, "contract", _rust_functions(_task), _FACTS + _where)

# --- Rust: whole files --------------------------------------------------------------------------------------------------

_SOURCE = "g as (select path, content as c, replace(content, chr(10), ' ') as flat, regexp_replace(content, '//[^\\n]*', '', 'g') as code from f)"
_FILE_RULES = {
    "211": f"{_re('flat', R.THREADS)} and {_re('flat', R.CELLS)}",
    "214": f"not contains(replace(c, ' ', ''), 'AsyncFn') and {_re('c', R.OLD_ASYNC)}",
    "217": f"{_re('c', R.STATE_WORDS)} and {_re('c', R.HASH_TABLES)}",
    "219": f"{_re('c', r'#\[\s*serde\s*\(\s*flatten\s*\)\s*\]')} and {_re('c', r'\b(?:Serialize|Deserialize)\b')}",
    "220": _re("c", r"\bfork_choice\b|\bForkChoice\b"),
    "221": f"{_re('c', '(?i)gas_limit')} and {_re('c', r'(?i)batcher|\bbatch\b')}",
    "222": f"{_re('c', r'(?i)\bproposal\b')} and {_re('c', R.U64_PAIR)} and not {_re('c', R.RANGE_GUARD)}",
    "223": f"{_re('code', r'\bpanic_with_error\s*!')} and {_re('code', r'\bpanic!\s*\(')}",
}
_STATICS = r"list_sort(list_distinct(regexp_extract_all(c, '\bstatic\s+mut\s+([A-Za-z_][a-zA-Z0-9_]*)\s*[:=]', 1)))"
_FILE_LISTS = {
    "210": rf"list_filter({_STATICS}, lambda x: regexp_matches(c, '&(?:mut\s+)?' || x || '\b'))",
    "215": f"list_filter(regexp_extract_all(c, {literal(R.BORROWED_CALL)}), lambda x: not contains(x, 'panic'))[1:{R.CAPS['215']}]",
}


for _task, _where in _FILE_RULES.items():
    _add(_task, "file", R.file_alerts, f"{_SOURCE} select path, '' as function_name, 0::int as idx, '' as detail, '' as statement from g where {_where}")
for _task, _list in _FILE_LISTS.items():
    _add(_task, "file", R.file_alerts, f"{_SOURCE}, l as (select path, {_list} as xs from g) select path, '' as function_name, (generate_subscripts(xs, 1) - 1)::int as idx, unnest(xs) as detail, '' as statement from l")

# --- Rust: lines and their neighbours -----------------------------------------------------------------------------------

_LINES = """l as (select path, regexp_split_to_array(content, '\\r?\\n') as xs, content as c from f),
r as (select path, generate_subscripts(xs, 1) as n, unnest(xs) as line, c from l), k as (select *, string_split(line, '//')[1] as code from r),
q as (select *, string_agg(line, chr(10)) over (partition by path order by n rows between 15 preceding and current row) as before, string_agg(line, chr(10)) over (partition by path order by n rows between 42 preceding and current row) as above,
  string_agg(code, chr(10)) over (partition by path order by n rows between current row and 159 following) as after from k)
select path, '' as function_name, n::int as idx, """
_TESTED = _re("above", R.CFG_TEST_LINE)
_LINE_RULES = {
    "209": f"left(trim(line), 120) as detail, '' as statement from q where {_re('code', R.UNSAFE)} and not {_re('before', R.SAFETY)} and not {_TESTED}",
    "216": rf"left(trim(code), 120) as detail, '' as statement from q where {_re('left(c, 8000)', r'#!\[\s*no_std\s*\]')} and not {_re('line', R.CFG_STD)} and {_re('trim(code)', r'\bstd\s*::')} and not starts_with(trim(code), '#[') qualify row_number() over (partition by path order by n) <= {R.CAPS['216']}",
    "218": f"'' as detail, '' as statement from q where {_re('code', R.SPAWN)} and not {_TESTED} and {_re('after', R.SPAWN_PANICS)} qualify row_number() over (partition by path order by n) <= {R.CAPS['218']}",
}


for _task, _select in _LINE_RULES.items():
    _add(_task, "file", R.line_alerts, _LINES + _select)

# --- Solidity -----------------------------------------------------------------------------------------------------------

def _inner(word: str) -> str:
    return f"list_transform(regexp_extract_all(body, {literal(rf'\b{word}\s*({_NEST})')}, 1), lambda x: x[2:-2])"


def _places(tokens: list[str]) -> str:
    return f"list_filter(range(len(stmts)), lambda i: {_any('stmts[i + 1]', tokens)})"


_SOL = f"""{derived.functions_sql('solidity')}, a as (select *, {_pieces('body', 0)} as stmts, {_inner('if')} || {_inner('require')} || {_inner('assert')} as guards, {_inner('assert')} as asserts,
  lower(name) as low, lower(body) as lbody, trim(params) <> '' as has_inputs, list_filter(regexp_split_to_array(trim(modifiers), '[\\s(),]+'), lambda m: {_re('lower(m)', 'only|owner|admin|role')}) as permissions from t),
b as (select *, list_filter(stmts, lambda s: contains(s, '=') and len(list_filter(state, lambda v: contains(s, v))) > 0) as mutations, list_filter(stmts, lambda s: {_any('s', S.TRANSFERS)}) as transfers,
  list_filter(stmts, lambda s: len(list_filter({literal(S.MATH)}, lambda t: contains(s, t))) >= 2) as computations, len(guards) = 0 and len(permissions) = 0 as is_open,
  contains(low, 'stake') and not contains(low, 'unstake') as stakes, contains(low, 'unstake') as unstakes, contains(low, 'mint') or contains(low, 'burn') as mints,
  substr(lbody, greatest(strpos(lbody, 'catch'), 1)) as caught, {_places(S.ORDER_TRANSFERS)} as moved, {_places(S.ORDER_FETCHES)} as fetched from a)
"""
_MONEY = f"list_filter(mutations, lambda m: {_any('lower(m)', S.MONEY)})"
_CHANGED = lambda *t: f"list_distinct(list_filter(mutations, lambda m: {_any('m', list(t))}))"
_MATH = """list_filter([case when (contains(lower(s), '.mul') and contains(lower(s), '.div')) or (contains(s, '*') and contains(s, '/')) then 'mul-div: ' || s end, case when contains(lower(s), '.div') or contains(s, '/') then 'div: ' || s end,
  case when contains(lower(s), 'math.') then 'math: ' || s end, case when contains(s, '((') and (contains(lower(s), '.mul') or contains(lower(s), '.div') or contains(lower(s), '.sub') or contains(lower(s), '.add')) then 'parentheses: ' || s end], lambda x: x is not null)"""
_TRIED = "contains(lbody, 'try') and contains(lbody, 'catch')"
#: task: (condition on a function, list of details)
_SOL_RULES = {
    "2": [(f"is_open and has_inputs and len({_MONEY}) > 0", f"[{_MONEY}[1]]")],
    "3": [
        ("stakes", "['stake']"),
        ("unstakes", "['unstake']"),
        ("true", "list_filter(stmts, lambda s: contains(lower(s), ' stake'))"),
        ("true", "list_filter(stmts, lambda s: contains(lower(s), ' unstake'))"),
        ("stakes", _CHANGED("+=", " + ")),
        ("unstakes", _CHANGED("-=", " - ")),
    ],
    "4": [("mints and visibility = 'external' and len(permissions) = 0", "['']"), ("mints", "guards"), ("contains(low, 'burn')", "list_filter(stmts, lambda s: contains(s, 'address(0)'))")],
    "5": [(f"{_any('low', S.RECEIVERS)} and not contains(low, 'stake')", f"list_filter({literal(S.POINTS)}, lambda p: list_contains(state, p) and len(list_filter(guards, lambda g: contains(g, p))) = 0)")],
    "6": [(f"{_TRIED} and contains(caught, 'revert')", "[coalesce(list_filter(stmts, lambda s: contains(lower(s), 'revert'))[1], caught)]"), (f"{_TRIED} and len(asserts) > 0", "[array_to_string(asserts, ', ')]")],
    "7": [("true", f"flatten(list_transform(list_distinct(computations), lambda s: {_MATH}))")],
    "8": [("len(moved) > 0 and (len(fetched) = 0 or fetched[1] >= moved[1])", "['no fetch before transfer']"), ("len(fetched) > 0 and (len(moved) = 0 or moved[-1] <= fetched[1])", "['no transfer after fetch']")],
    "9": [(f"len(guards) = 0 and len(list_filter(transfers, lambda s: {_any('lower(s)', ['withdraw', 'unstake', 'transfer'])})) > 0", "[transfers[1]]")],
    "11": [("visibility = 'external' and has_inputs and len(mutations) > 0 and is_open", "['']")],
}
_NO_UNSTAKE = "select path, type_name as function_name, 0::int as idx, 'no unstake' as detail, '' as statement from b group by path, type_name having bool_or(stakes) and not bool_or(unstakes)"


def _sol_functions(task: str):
    return lambda src: S.solidity_alerts(src, task, Facts(src.sparkSession).contracts(src))


for _task, _parts in _SOL_RULES.items():
    _rows = [f"select path, type_name || '.' || name as function_name, 0::int as idx, unnest({d}) as detail, '' as statement from b where {c}" for c, d in _parts]
    _add(_task, "solidity", _sol_functions(_task), _SOL + " union all ".join(_rows + [_NO_UNSTAKE] * (_task == "3")))

_COMMENTS = f"""c as (select path, unnest(regexp_extract_all(content, '(?s)/\\*.*?\\*/|(?m:^[ \\t]*//[^\\n]*)')) as x from f), w as (select path, x, unnest({literal(S.COMMENT_WORDS)}) as word from c)
select path, '' as function_name, 0::int as idx, trim(word) as detail, '' as statement from w where contains(x, word)"""
_add("1", "solidity", S.comment_alerts, _COMMENTS)
_add("10", "solidity", _sol_functions("10"), None)

# --- Solidity: what functions read, write and check ---------------------------------------------------------------------

_READS = f"""with {derived.sql('solidity')}, {derived.functions_sql('solidity')}, a as (select *, list_distinct({_pieces('body', 0)}) as stmts from t), b as (select path, type_name, name, state, unnest(stmts) as s from a), c as (select *, unnest(state) as v from b)
select path, type_name, name as fn_name, v as entity_name, case when contains(s, '=') then 'write' else 'read' end as access_kind, s as source_statement from c where contains(s, v)"""
_GUARDS = [f"select path, type_name, name as fn_name, '{kind}' as guard_type, unnest({_inner(word)}) as expression, '{reason}' as confidence_reason from t" for kind, word, reason in (("conditional", "if", "parsed_function_conditional"), ("require", "require", "parsed_require_statement"), ("assert", "assert", "parsed_assert_statement"))]


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contracts_of(Facts(spark).contracts(derived.sources(spark, sf_dir, "solidity")))


def state_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each function of the derived contracts reads and writes, with the statement."""
    return adapters.state_accesses(_contracts(spark, sf_dir)).drop("fn_ord")


def guard_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each function of the derived contracts checks, and how."""
    return adapters.guard_facts(_contracts(spark, sf_dir)).drop("fn_ord", "ord")


QUERIES |= {"state_accesses": state_accesses, "guard_facts": guard_facts}
SQL |= {"state_accesses": _READS, "guard_facts": f"with {derived.sql('solidity')}, {derived.functions_sql('solidity')} " + " union all ".join(_GUARDS)}


#: The common tables of _FACTS up to w, which the rules read on.
_RUST_FACTS = _FACTS[: _FACTS.index("v as (select")].rstrip().rstrip(",")
_TIGHT = "replace(u, ' ', '')"
SQL["rust_facts"] = f"""with {derived.sql('contract')}, {_RUST_FACTS} select path, name as function_name, visibility, contract and visibility in ('external', 'crate') as is_entrypoint, {_re('u', r'\.require_auth\s*\(|require_auth_for_args\s*\(')} as calls_require_auth,
  contains(low, 'extend_ttl') as calls_extend_ttl, inst as writes_instance, pers as writes_persistent, temp as writes_temporary, inst or pers or temp as mutates, contains(u, '.storage()') as reads_any_storage,
  contains(replace({_TIGHT}, 'try_invoke_contract', ''), 'invoke_contract(') as invoke_contract_plain, contains({_TIGHT}, 'try_invoke_contract') as try_invoke_contract, contains({_TIGHT}, 'invoke_contract(') as invoke_or_try,
  {_re('u', r'\bpanic\s*!\s*\(')} as panic_bare, {_re('u', r'\b(?:assert|debug_assert)\s*!\s*\(')} as panic_assert, contains({_TIGHT}, 'panic_with_error!(') as panic_with_error, {_any('u', ['for ', '.iter()', ' while '])} and contains(u, '.storage()') and {_any('u', ['.get(', '.has('])} as reads_storage_in_loop,
  {_any('u', ['.get(', '.has('])} as reads_storage_flat, starts_with(name, '__constructor') as constructor_like, {_re('signature', r'\bVec\s*<|\bMap\s*<')} as params_have_vec_map, contract as within_contractimpl from w"""


def rust_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of the public functions of the derived contracts."""
    src = derived.sources(spark, sf_dir, "contract")
    return R.all_facts(R.with_facts(Facts(spark).functions(src), src))


QUERIES["rust_facts"] = rust_facts
