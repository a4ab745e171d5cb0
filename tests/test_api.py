import hashlib

import pytest

from quarry import api
from quarry.sources import code
from quarry.sources.corpus import corpus


def test_tasks_and_errors(spark):
    assert [r.task_id for r in api.list_tasks(spark, "c").collect()] == [str(k) for k in range(101, 121)] + ["all"]
    assert api.list_tasks(spark).count() == 55
    src = corpus(spark)
    for call, code in ((lambda: api.analyze(src, "999"), "unknown_task"), (lambda: api.analyze(src, "101", "x"), "unknown_mode"), (lambda: api.list_tasks(spark, "go"), "unsupported_language")):
        with pytest.raises(api.AuditError) as e:
            call()
        assert e.value.code == code


def test_analyze_graph_summary(spark):
    src = corpus(spark)
    one = api.analyze(src, "101").collect()
    assert {e.function_name for r in one for e in r.evidences} == {"bad_101"}
    assert api.analyze(src, "101", "legacy").columns == ["code", "message"]
    catalog = spark.createDataFrame([("101", "Casts", "math", "c", "check it")], "task_id string, title string, category string, portability string, remediation_hint string")
    card = api.render(api.analyze(src, "101", catalog=catalog)).first().card.split("\n")
    assert card[:5] == ["[Task 101] Casts", "Category: math", "Portability: c", "Confidence: medium", "Message: " + one[0].message]
    assert card[5] == "Hint: check it" and card[6].startswith("Evidence: ") and "Function: bad_101" in card and card[-1].startswith("Reason: ")
    got = {r.path: r for r in api.summary(src).collect()}
    assert got["node/rules.c"].functions == 38 and got["empty.c"].functions == 0 and got["node/rules.c"].statements > 60


def test_one_graph_for_all_languages(spark):
    sol = """import "./Base.sol";
contract Bank is Base {
    uint total;
    event Paid(uint v);
    modifier open() { require(ready); _; }
    function pay(uint v) public open { require(v > (1 + (2 * (3)))); total += v; emit Paid(v); }
    function add(uint a, uint b) internal { pay(a + total); token.transfer(b, 1); }
}
contract Other { event Gone(); uint x; function look() external view returns (uint) { return x; } }
"""
    c = "#include \"lib/util.c\"\n#include \"old/util.c\"\nstruct node { int v; };\ntypedef struct { struct { int a; } b; } pool_t;\nvoid go( pool_t * p ) { fd_log( 1 ); go2( p ); SYS_write( 2 ); }\nstatic void go2( struct node * n ) { go( n ); }\n"
    rust = "#[contractimpl]\nimpl V { pub fn set(env: Env, w: Address) { w.require_auth(); env.storage().instance().set(&K, &1); note(w); note(w); }\n pub fn note(w: Address) { } }\n"
    src = spark.createDataFrame([("b/Bank.sol", 0, "solidity", sol), ("b/Base.sol", 1, "solidity", "contract Base { uint kept; function hold() public { kept = 1; } }"), ("b/go.c", 2, "c", c), ("b/lib.rs", 3, "rust", rust), ("b/none.c", 4, "c", None)], code.SOURCES)
    nodes, edges = api.graph(src)
    n = {(x.path, x.id): x for x in nodes.collect()}
    e = {(x.path, x.source, x.target, x.kind): x for x in edges.collect()}
    assert {i for p, i in n if p == "b/Bank.sol"} == {
        "type:Bank", "type:Other", "function:Bank.pay", "function:Bank.add", "function:Other.look", "state:Bank.total", "state:Other.x", "event:Bank.Paid", "event:Other.Gone", "modifier:Bank.open",
    }
    pay, add = n["b/Bank.sol", "function:Bank.pay"], n["b/Bank.sol", "function:Bank.add"]
    assert (pay.guards, pay.state_writes, pay.modifiers, pay.is_entrypoint, pay.calls_event) == (["v > (1 + (2 * (3)))"], ["total += v"], ["open"], True, True)
    assert [tuple(p) for p in pay.write_paths] == [("self -> total += v", "high")] and [tuple(p) for p in add.write_paths] == [("v <- a + total (input) -> pay -> total += v", "heuristic")]
    assert n["b/Bank.sol", "function:Other.look"].state_reads == ["x"] and n["b/Bank.sol", "modifier:Bank.open"].kind == "declared"
    call = e["b/Bank.sol", "function:Bank.add", "function:Bank.pay", "function_to_function"]
    assert call.callsite == "pay(a + total)" and [tuple(a) for a in call.args_map] == [("v", "a + total", "input")]
    go, used = "function:b/go.c.go", n["b/go.c", "tile:go"]
    assert used.group == "tile" and n["b/go.c", go].callees == ["fd_log", "go2", "SYS_write"] and n["b/go.c", go].calls_include_template
    assert {i for p, i in n if p == "b/go.c" and n[p, i].group == "workspace"} == {"workspace:node", "workspace:pool_t", "workspace:inc:util.c", "workspace:inc:util.c~" + hashlib.sha256(b"old/util.c").hexdigest()[:8]}
    assert {(t, k) for p, s, t, k in e if (p, s) == ("b/go.c", go)} == {("external:unresolved_lib:fd_log", "function_to_function"), ("function:b/go.c.go2", "function_to_function"), ("external:unresolved_syscall:SYS_write", "function_to_syscall"), ("workspace:pool_t", "function_to_workspace")}
    assert e["b/go.c", go, "external:unresolved_syscall:SYS_write", "function_to_syscall"].confidence == "high"
    assert {(s, t, k) for p, s, t, k in e if p == "b/lib.rs"} == {("function:lib.set", "state:lib.LedgerInstancePartition", "function_to_object"), ("state:lib.AuthLedgerCheck", "function:lib.set", "state_to_function"), ("function:lib.set", "function:lib.note", "function_to_function")}
    assert edges.where("path = 'b/lib.rs' and label = 'intracontract_call'").count() == 2  # a call made twice is two edges
    assert ("b/none.c", "tile:none") in n
    assert {r.path: (r.node_count, r.large_graph_warning) for r in api.graph_hints(nodes, edges).collect()}["b/none.c"] == (1, False)
    bn, be = api.graph(src, "bundle")
    assert {x.id for x in bn.collect()} == {f"{p[2:]}::{i}" for p, i in n}
    assert [(x.source, x.target) for x in be.where("kind = 'bundle_import'").collect()] == [("Bank.sol::type:Bank", "Base.sol::type:Base")]
