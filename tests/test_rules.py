from collections import defaultdict

import pytest

from quarry.plans import audit
from quarry.sources import code, corpus


@pytest.fixture(scope="module")
def found(spark):
    return audit.findings(corpus.corpus(spark)).collect()


def test_c_rules(found):
    by = defaultdict(set)
    for r in found:
        if r.path == "node/rules.c":
            by[r.task_id].add(r.function_name.split(".")[1])
    for task in range(101, 121):
        if task != 105:
            assert f"bad_{task}" in by[str(task)], task
            assert f"ok_{task}" not in by[str(task)], task
    assert sum(r.task_id == "105" for r in found) == 9


def test_rust_rules(found):
    tasks = defaultdict(set)
    for r in found:
        if r.path.endswith(".rs"):
            tasks[r.task_id].add(r.function_name.split(".")[-1])
    for task in (201, 202, 203, 204, 205, 206, 207, 212, 213):
        assert f"bad_{task}" in tasks[str(task)], task
        assert f"ok_{task}" not in tasks[str(task)], task
    assert tasks["208"] == {"__constructor_bad_208"}
    for task in (209, 210, 211, 214, 215, 216, 217, 218, 219, 220, 221, 222, 223):
        assert tasks[str(task)] == {""}, task
    assert sum(r.task_id == "216" for r in found) == 1
    assert sum(r.task_id == "209" for r in found) == 1


def test_evidence_lines(found):
    lines = corpus.C_RULES.split("\n")
    for r in found:
        if r.path == "node/rules.c" and r.line_number:
            assert r.message.split(": ", 2)[-1].split(": ")[-1] in lines[r.line_number - 1] or r.task_id in ("103", "107", "110", "111", "112")
    assert any(r.line_number for r in found)


def test_readers(tmp_path, spark):
    (tmp_path / "a.c").write_bytes(b"int f( int a, char * b ) { return 1; } // \xff\n/* void g( ) { } */ static void h( void ) { if( x ) { y( ); }")
    (tmp_path / "b.txt").write_text("no source")
    src = code.read_sources(spark, str(tmp_path))
    assert [(r.fn_name, r.visibility) for r in code.functions_of(src).orderBy("fn_ord").collect()] == [("f", "external"), ("h", "internal")]
    assert code.functions_of(src.limit(0)).collect() == [] and audit.alerts(src.limit(0)).collect() == []


def test_solidity_rules(found):
    by = defaultdict(lambda: defaultdict(int))
    for r in found:
        if r.path.endswith(".sol"):
            by[r.task_id][r.function_name.split(".")[-1]] += 1
    assert dict(by["1"]) == {"": 2}  # " version " and " old "
    assert "bad_2" in by["2"] and "ok_2" not in by["2"]
    assert by["3"]["stakeIt"] == 2 and by["3"]["Vault"] == 1
    assert by["4"]["mintAll"] == 2 and by["4"]["burnSome"] == 2
    assert by["5"]["takePoint"] == 2 and by["5"]["ok_5_takePoint"] == 1  # balance is checked in neither
    assert by["6"]["bad_6"] == 2
    assert by["7"]["bad_7"] == 2
    assert by["8"]["bad_8"] == 2 and "ok_8" not in by["8"]
    assert set(by["9"]) == {"bad_9"}
    assert by["10"]["Vault"] == 1
    assert set(by["11"]) == {"bad_11"}


def test_contracts(spark):
    from quarry.sources.code import solidity_contracts

    rows = solidity_contracts(corpus.corpus(spark)).collect()
    vault = [r for r in rows if r.type_name == "Vault"]
    assert vault[0].state == ["balance", "point", "owner", "nameOfVault", "nameOfVaults", "shares"] and vault[0].parents == ["Base", "Named"]
    assert [r.fn_name for r in rows if r.type_name == "Thing"] == ["plain"]


def test_public_panics_need_a_name_before_the_call(spark):
    """What stands between the boundary and the dot decides: x.unwrap() is reported, f().unwrap() is not."""
    text = "pub fn a(x: X) -> u32 { x.unwrap() }\npub fn b() -> u32 { f().unwrap() }\npub fn c() { panic!(\"no\") }"
    src = spark.createDataFrame([("a/lib.rs", 0, "rust", text)], code.SOURCES)
    assert {r.function_name for r in audit.alerts(src).where("task_id = '212'").collect()} == {"lib.a", "lib.c"}


def test_quoted_comments_stay():
    assert code.without_solidity_comments('string s = "http://x"; // gone\n\'//\' /* a */') .rstrip() == 'string s = "http://x";        \n\'//\''


def test_full_findings(spark, found):
    catalog = spark.createDataFrame([("114", "Keys", "crypto", "node", "check possession"), ("114", "Keys", "crypto", "node", "check possession"), ("999", "x", "x", "x", "x")], "task_id string, title string, category string, portability string, remediation_hint string")
    rows = audit.full_findings(corpus.corpus(spark), catalog).collect()
    assert sorted((r.path, r.task_id, r.message) for r in rows) == sorted((r.path, r.task_id, r.message) for r in found)
    one = next(r for r in rows if r.task_id == "114")
    assert (one.legacy_code, one.title, one.category, one.portability, one.remediation_hint) == (114, "Keys", "crypto", "node", "check possession")
    e = one.evidences[0]
    assert (e.type_name, e.function_name, e.statement, e.confidence_reason) == ("rules", "bad_114", "bls_aggregate( k )", "matched_statement_from_normalized_model")
    lines = corpus.C_RULES.split("\n")
    assert e.line_numbers and all("bls_aggregate( k )" in lines[n - 1] for n in e.line_numbers) and e.line_number == e.line_numbers[0]
    other = next(r for r in rows if r.task_id == "206")
    assert other.title == "Improper Error Signaling" and other.category == "" and other.evidences[0].function_name == "bad_206"
    whole = next(r for r in rows if r.task_id == "220")
    assert whole.evidences[0].confidence_reason == "message_only_fallback" and whole.evidences[0].line_numbers == []
    assert audit.full_findings(corpus.corpus(spark).limit(0)).collect() == []


def test_one_task_computes_its_rule_alone(spark):
    src = corpus.corpus(spark)
    every = defaultdict(list)
    whole = audit.alerts(src)
    for r in whole.collect():
        every[r.task_id].append(tuple(r))
    for task in ("1", "3", "10", "11", "101", "105", "113", "201", "209", "217"):
        assert sorted(tuple(r) for r in audit.alerts(src, task).select(*whole.columns).collect()) == sorted(every[task]), task
    plan = lambda task: audit.alerts(src, task)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan("101") and "Window" in plan("108")
    assert "MapInPandas" not in plan("205") and "MapInPandas" not in plan("2")  # parsed before, and kept


def test_line_rules_join_nothing(spark):
    from quarry.operators import rust_rules

    comments = ["// SAFETY: held"] + ["x;"] * 15 + ["unsafe { a }"] + ["// SAFETY: held"] + ["y;"] * 14 + ["  unsafe { b } // c"]
    spawned = ["#[cfg(test)]"] + [";"] * 42 + ["tokio::spawn(a); "] + [";"] * 159 + ["a.unwrap()"] + ["tokio::spawn(b);"] * 10 + [";"] * 50 + ["b.unwrap() // c"]
    bare = ["#![no_std]", "use std::a; // b", "#[std::c]", "use core::d; // std::e"]
    rows = [("a.rs", 0, "rust", "\n".join(comments)), ("b.rs", 1, "rust", "\r\n".join(spawned)), ("c.rs", 2, "rust", "\n".join(bare)), ("d.rs", 3, "rust", None), ("e.c", 4, "c", "unsafe { a }")]
    df = rust_rules.line_alerts(spark.createDataFrame(rows, "path string, file_ord int, language string, content string"))
    got = sorted((r.path, r.task_id, r.idx, r.detail) for r in df.collect())
    assert got == [("a.rs", "209", 17, "unsafe { a }")] + [("b.rs", "218", n, "") for n in range(205, 213)] + [("c.rs", "216", 2, "use std::a;")]
    # lines that were joined with their neighbours went whole to the driver and all tasks where the planner thought them few
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_names_that_repeat_are_compared_once(spark, monkeypatch):
    import difflib

    from quarry.operators import solidity_rules

    monkeypatch.setattr(solidity_rules, "GROUP_PART", 3)
    names = [f"Supplier#{k:04d}" for k in (1, 2, 12, 211, 9999)] + ["short", None]
    rows = [(g, names[k % 7], k) for g in ("x", "y", None) for k in range(40)]
    df = solidity_rules.similar_names(spark.createDataFrame(rows, "g string, name string, ord int"), ["g"])
    got = sorted((r.g, r.a_name, r.b_name, r.a_ord, r.b_ord) for r in df.collect())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = sorted((g, a, b, i, j) for g, a, i in rows for h, b, j in rows if g is not None and g == h and a and b and i < j and (len(a) - len(b)) / max(len(a), len(b)) < 0.2 and ratio(a, b) > 0.9)
    assert got == want
    # the comparisons come before the rows that share a name, and are of different names
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("ArrowEvalPython"):]


def test_only_names_that_may_be_alike_are_compared(spark, monkeypatch):
    """Names of many lengths, with one to three characters more, less, moved or other; all pairs by the library against few by keys."""
    import difflib
    import random

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from quarry.operators import solidity_rules

    r = random.Random(7)

    def changed(s):
        for _ in range(r.randrange(4)):
            i = r.randrange(len(s) + 1)
            s = r.choice([s[:i] + r.choice("abé😀") + s[i:], s[:i] + s[i + 1 :], s[:i] + r.choice("xyz") + s[i + 1 :]])
        return s

    bases = ["".join(r.choice("abcdefgé") for _ in range(n)) for n in (4, 11, 18, 20, 31, 33, 64, 210)]
    names = ["", "a", "aa", None] + [changed(b) for b in bases for _ in range(30)]
    names += names[:40] + ["aaaa" * 60] * 2
    rows = [(k % 2, name, k * 7919 % 1009) for k, name in enumerate(names)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = sorted((g, a, b, i, j) for g, a, i in rows for h, b, j in rows if g == h and a and b and i < j and (len(a) - len(b)) / max(len(a), len(b)) < 0.2 and ratio(a, b) > 0.9)
    df = spark.createDataFrame(rows, "g int, name string, ord int")
    for part, worth in ((20, 0), (20, 8), (20, 10**9), (10**6, 8)):
        monkeypatch.setattr(solidity_rules, "GROUP_PART", part)
        monkeypatch.setattr(solidity_rules, "SUBSEQUENCE", worth, raising=False)
        got = sorted((r.g, r.a_name, r.b_name, r.a_ord, r.b_ord) for r in solidity_rules.similar_names(df, ["g"]).collect())
        assert got == want, (part, worth)
    monkeypatch.undo()
    compared = spark.sparkContext.accumulator(0)

    @pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    monkeypatch.setattr(solidity_rules, "name_ratio", counted)
    many = spark.range(1500).selectExpr("1 as g", "format_string('Supplier#%09d', id) as name", "id as ord")
    assert solidity_rules.similar_names(many, ["g"]).count() > 20_000
    assert compared.value < 60_000


def test_audits_report_every_place(spark):
    """More places in a file than the rules on their own report: an audit has them all, with all rules or with one."""
    from quarry.operators import rust_rules

    lines = ["#![no_std]"] + [f"fn f{i}() {{ let x{i} = &make({i}); }}" for i in range(9)] + [f"use std::a{i};" for i in range(40)] + ["tokio::spawn(a);"] * 12 + ["a.unwrap()"]
    src = spark.createDataFrame([("a.rs", 0, "rust", "\n".join(lines))], "path string, file_ord int, language string, content string")
    places = {"215": list(range(9)), "216": list(range(11, 51)), "218": list(range(51, 63))}
    whole = audit.findings(src).where("task_id in ('215', '216', '218')").collect()
    for task, want in places.items():
        assert sorted(r.idx for r in whole if r.task_id == task) == want, task
        assert sorted(r.idx for r in audit.alerts(src, task).collect()) == want, task
        alone = rust_rules.file_alerts(src) if task == "215" else rust_rules.line_alerts(src)
        assert sorted(r.idx for r in alone.where(f"task_id = '{task}'").collect()) == want[: rust_rules.CAPS[task]], task
