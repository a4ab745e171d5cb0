import hashlib
import json
import threading

import pytest

from quarry import api
from quarry.operators import calls, code_graph, graph
from quarry.operators.history import ARTIFACT, FINDING, SCAN, History, bundles, catalog_hash, tool_version
from quarry.api import AuditError
from quarry.plans import audit
from quarry.sources.code import SOURCES, bundle_members, read_sources, read_target


def test_history(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    up = [(1, "x/a.c", b"int f;"), (2, "b.c", b"int f;"), (3, "c.txt", b"z"), (4, "d.rs", b""), (5, "e.rs", b"fn"), (6, "f.sol", b"x" * (2 << 20) + b"y")]
    got = {r.ord: (r.status, r.artifact_id) for r in h.ingest(spark.createDataFrame(up, "ord int, filename string, content binary"), "2024-01-01").collect()}
    assert got == {1: ("ok", 1), 2: ("ok", 1), 3: ("unsupported_extension", None), 4: ("empty_file", None), 5: ("ok", 2), 6: ("too_large", None)}
    again = h.ingest(spark.createDataFrame([(1, "z.c", b"int f;"), (2, "new.h", b"n")], "ord int, filename string, content binary"), "2024-01-02").collect()
    assert {r.ord: r.artifact_id for r in again} == {1: 1, 2: 3}
    assert [(r.id, r.filename) for r in h.list_artifacts().collect()] == [(3, "new.h"), (2, "e.rs"), (1, "a.c")]
    assert len(h.list_artifacts(0).collect()) == 1

    scans = [(i, a, "auditor", "all", "[]", 2, 5, "v", "ok", "", f"2024-01-0{i}", "h", "") for i, a in ((1, 1), (2, 1), (3, 2))]
    finds = [(1, 0, "r", "T", "f", "s", "", "m"), (1, 1, "r", "T", "g", "", "t", "m"), (1, 2, "r", "T", "g", "", "t", "m"), (2, 0, "r", "T", "g", "", "t", "m"), (2, 1, "q", "T", "g", "", "t", "m")]
    h.record(spark.createDataFrame(scans, SCAN), spark.createDataFrame(finds, FINDING))
    assert sorted((r.rule_id, r.function_name, r.change) for r in h.diff(1, 2).collect()) == [("q", "g", "added"), ("r", "f", "removed"), ("r", "g", "unchanged")]
    with pytest.raises(ValueError, match="artifact_mismatch"):
        h.diff(1, 3)
    assert h.soft_delete(2, "2024-02-01") and not h.soft_delete(2, "2024-02-02") and not h.soft_delete(9, "x")
    assert [r.id for r in h.list_scans().collect()] == [3, 1]
    assert [r.id for r in h.list_scans(1, include_deleted=True).collect()] == [2, 1]
    assert h.scan_details(1).first().filename == "a.c"


def test_two_writers(spark, tmp_path):
    """Two writers take the same and other files and keep scans at once: ids are given once, contents are stored once."""
    root = str(tmp_path / "h")
    writers = [History(spark, root), History(spark, root)]
    out, errors = [[], []], []

    def work(k):
        try:
            for i in range(3):
                up = [(0, "both.c", f"int both{i};".encode()), (1, f"own{k}.c", f"int own{k}_{i};".encode())]
                got = writers[k].ingest(spark.createDataFrame(up, "ord int, filename string, content binary"), f"2024-01-0{i + 1}").collect()
                ident = next(r.artifact_id for r in got if r.ord == 1)
                rows = spark.createDataFrame([(0, f"r{k}", "T", "f", "s", "s", f"m{i}")], "ord int, rule_id string, type_name string, function_name string, source_statement string, statement string, message string")
                out[k].append((writers[k].save_ok(ident, "auditor", "all", rows, "2024-02-01", []), f"r{k}", f"m{i}"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    h = History(spark, root)
    artifacts = h.artifacts.collect()
    assert sorted(a.id for a in artifacts) == list(range(1, 10)) and len({a.sha256 for a in artifacts}) == 9
    assert sorted(i for i, _, _ in out[0] + out[1]) == [1, 2, 3, 4, 5, 6]
    for ident, rule, message in out[0] + out[1]:
        assert [(r.rule_id, r.message) for r in h.get_findings(ident).collect()] == [(rule, message)]
    log = h.log.entries()
    assert len(log) >= 9 and log[-1]["ids"] == {"artifact": 9, "scan": 6}
    # a draft that was never claimed doesn't show, and a number is given once
    spark.createDataFrame([(99, "x", "x.c", "c", 1, "t")], ARTIFACT).write.parquet(f"{root}/artifact/stray")
    assert h.artifacts.count() == 9 and not h.log._claim(len(log), {})
    (tmp_path / "h" / "_log" / "999999999999.json").write_text('{"schema": 2, "stage": "s", "tables": [], "ids": {}}')
    with pytest.raises(ValueError, match="newer"):
        History(spark, root)


def test_bundles(spark):
    parts = [("x", "a.c", b"1"), ("x", "d/a.c", b"2"), ("y", "d/a.c", b"2"), ("y", "a.c", b"1"), ("z", "a.c", b"1"), ("z", "b.rs", b"1"), ("w", "a.txt", b"1")]
    got = {r.bundle: r for r in bundles(spark.createDataFrame(parts, "bundle string, filename string, content binary")).collect()}
    assert got["x"].digest == got["y"].digest and got["x"].members == "a.c,a_2.c" and got["x"].status == "ok"
    assert got["z"].status == "mixed_languages" and got["w"].status == "unsupported_extension"


    assert got["x"].filename == "bundle:a.c (+1 more)" and got["w"].filename == "bundle:a.txt"
    manifest = json.loads(got["x"].manifest)
    assert manifest["version"] == 1 and manifest["language"] == "c" and manifest["members"] == sorted(({"path": n, "sha256": hashlib.sha256(c).hexdigest()} for n, c in (("a.c", b"1"), ("a_2.c", b"2"))), key=lambda m: m["path"])


def test_bundle_members(spark):
    files = spark.createDataFrame([("b.c", "2"), ("a.c", "1"), ("other.c", "3")], "path string, content string")
    made = lambda *names: spark.createDataFrame([([(n,) for n in names],)], "members array<struct<path:string>>")
    assert [(r.path, r.content) for r in bundle_members(made("b.c", "", None, "a.c"), files).collect()] == [("a.c", "1"), ("b.c", "2")]
    with pytest.raises(ValueError, match="gone.c"):
        bundle_members(made("a.c", "gone.c"), files)
    with pytest.raises(ValueError, match="names no files"):
        bundle_members(made(""), files)


def test_scans_are_kept(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    h.ingest(spark.createDataFrame([(1, "a.c", b"int f( void ) { bls_aggregate( k ); }")], "ord int, filename string, content binary"), "2024-01-01")
    source = h.source(1)
    found = audit.findings(source)
    kept = found.selectExpr("row_number() over (order by task_id, idx) - 1 as ord", "rule_id", "'' as type_name", "function_name", "message as source_statement", "'' as statement", "message")
    ok = h.save_ok(1, "auditor", "all", kept, "2024-01-02", ["114"], tool_version("v7"), catalog_hash([list(r) for r in audit.RULES]), 5, api.graph(source))
    plain = h.save_ok(1, "legacy", "114", kept, "2024-01-03", ["114"])
    bad = h.save_failed(1, "auditor", "9", AuditError("unknown_task", "9"), "2024-01-04")
    assert (ok, plain, bad) == (1, 2, 3)
    rows = {r.id: r for r in h.list_scans(1).collect()}
    assert rows[1].findings_count == len(h.get_findings(1).collect()) == 1 and rows[1].tool_version == "v7" and len(rows[1].rules_catalog_hash) == 64
    assert (rows[3].status, rows[3].error_code, rows[3].error_message, rows[3].findings_count) == ("error", "unknown_task", "unknown_task: 9", 0)
    assert {json.loads(r.body)["id"] for r in h.get_graph(1).where("part = 'node'").collect()} == {"tile:a", "function:a.c.f", "external:unresolved_symbol:bls_aggregate"}
    assert h.get_graph(2) is None and h.export_graph(2, "t") is None and json.loads(h.export_graph(1, "t").first().line)["exported_at"] == "t"
    h.soft_delete(1, "2024-01-05")
    for read in (h.get_findings, h.get_graph):
        with pytest.raises(LookupError, match="not_found"):
            read(1)
    with pytest.raises(LookupError, match="artifact 9"):
        h.save_ok(9, "auditor", "all", kept, "t", [])
    with pytest.raises(ValueError, match="missing_field"):
        h.record(spark.createDataFrame([(4, 1)], "id long, artifact_id long"), spark.createDataFrame([], FINDING))
    assert h.by_digest(hashlib.sha256(b"int f( void ) { bls_aggregate( k ); }").hexdigest()).first().id == 1
    assert catalog_hash() == "" and tool_version(" ", str(tmp_path)) == "unknown"


def test_graph(spark):
    text = '#include "lib/pool.c"\nstruct w { int v; };\nstatic int get( struct w * x ) { return x->v; }\nint sum( struct w * x ) { return get( x ) + get( x ) + other( x ); }\n'
    nodes, edges = api.graph(spark.createDataFrame([("m.c", 0, "c", text)], SOURCES))
    assert sorted(r.id for r in nodes.collect()) == ["external:unresolved_symbol:other", "function:m.c.get", "function:m.c.sum", "tile:m", "workspace:inc:pool.c", "workspace:w"]
    assert sorted((r.source, r.target) for r in edges.collect()) == [("function:m.c.get", "workspace:w"), ("function:m.c.sum", "external:unresolved_symbol:other"), ("function:m.c.sum", "function:m.c.get"), ("function:m.c.sum", "workspace:w"), ("tile:m", "workspace:inc:pool.c")]
    few = edges.select("id", "source", "target", "kind")
    assert graph.drop_dangling(nodes, few.union(spark.createDataFrame([("i", "tile:m", "gone", "k")], few.schema))).count() == 5
    assert code_graph.dot(nodes, edges).count() == 11
    rows = [("a", "", 1), ("b", "a", 2), ("y", "x", 5), ("x", "y", 3), ("early", "x", 0), ("late", "x", 9), ("z", "gone", 4), ("self", "self", 6)]
    kept = {r.id: r.kept for r in calls.drop_parent_cycles(spark.createDataFrame(rows, "id string, parent string, ord int")).collect()}
    # in order: early sees a cycle, x breaks it, so y and late keep their parents
    assert kept == {"a": None, "b": "a", "early": None, "x": None, "y": "x", "late": "x", "z": "gone", "self": None}


def test_bundle_edges(spark):
    files = [("b/Main.sol", 'import "./lib/Token.sol";\n// import "./Old.sol";\nimport {X} from "./Main.sol";'), ("b/token.sol", ""), ("b/Old.sol", "")]
    rows = [(p, i, "solidity", t) for i, (p, t) in enumerate(files)]
    rows += [("r/lib.rs", 5, "rust", "mod store;\nuse crate::auth::check;\nuse std::fmt;"), ("r/store.rs", 6, "rust", "use super::lib;"), ("r/auth.rs", 7, "rust", "")]
    rows += [("c/main.c", 8, "c", '#include "pool.c"\n#include <util.h>'), ("c/pool.c", 9, "c", ""), ("c/util.h", 10, "c", ""), ("c/none.c", 11, "c", None)]
    got = sorted((r.source[5:], r.target[5:], r.kind) for r in code_graph.bundle_edges(spark.createDataFrame(rows, SOURCES)).collect())
    assert got == [("Main.sol", "token.sol", "bundle_import"), ("lib.rs", "auth.rs", "bundle_import"), ("lib.rs", "store.rs", "bundle_import"), ("main.c", "pool.c", "tile_to_tile"), ("main.c", "util.h", "tile_to_tile"), ("store.rs", "lib.rs", "bundle_import")]


def test_files_and_bundles_are_read_in_order(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k % 7}").mkdir(exist_ok=True)
        (tmp_path / f"f{k % 7}" / f"n{k}.c").write_bytes(b"int f%d; // \xff" % k)
    got = [(r.path, r.file_ord) for r in read_sources(spark, str(tmp_path)).orderBy("file_ord").collect()]
    assert [o for _, o in got] == list(range(30)) and [p for p, _ in got] == sorted(p for p, _ in got)
    with pytest.raises(Exception, match="UTF"):
        read_sources(spark, str(tmp_path), strict=True).select("content").collect()
    assert read_target(spark, str(tmp_path)).count() == 30
    (tmp_path / "bundle_manifest.json").write_text(json.dumps({"version": 1, "language": "c", "members": [{"path": "f2/n9.c", "sha256": ""}, {"path": "f0/n0.c", "sha256": ""}, {"path": "f0/n0.c", "sha256": ""}]}, indent=1))
    assert [(r.path, r.content[:6]) for r in read_target(spark, str(tmp_path)).collect()] == [("f0/n0.c", "int f0"), ("f2/n9.c", "int f9")]
    (tmp_path / "bundle_manifest.json").write_text(json.dumps({"members": [{"path": "f9/none.c"}]}))
    with pytest.raises(ValueError, match="none.c"):
        read_target(spark, str(tmp_path))


def test_substrings_of_texts(spark):
    from quarry.operators.keyed import contains_join

    texts = [(1, "a b c d e f g h"), (None, "x b c d e f g h\ni"), (2, "prea bpost"), (2, "say one two"), (3, None), (4, "")]
    parts = [(10, "a b c d e f g"), (None, "b c d e f g"), (11, "ea bp"), (12, "c d"), (13, "one"), (14, "y one tw"), (15, "e f g"), (16, None), (17, "q r s t")]
    want = sorted(((i, t, j, p) for i, t in texts for j, p in parts if t is not None and p is not None and p in t), key=str)
    t, p = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(parts, "part long, item string")
    assert sorted((tuple(r) for r in contains_join(t, "text", p, "item", ["doc"], ["part"]).collect()), key=str) == want and len(want) > 8
