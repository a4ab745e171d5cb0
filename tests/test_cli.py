import json

from quarry import cli


def test_cli(spark, tmp_path, capsys):
    f = tmp_path / "a.c"
    f.write_text("void f(double x) {\n  ulong y = (ulong)( x * 1.5 );\n}\n")
    for argv in ([], [str(tmp_path / "none.c")], [str(f), "999"], [str(f), "101", "loud"], [str(f), "101", "legacy", "xml"], [str(f), "101", "legacy", "text", "go"], [str(f), " "]):
        assert cli.main(argv, spark) == cli.USAGE
    capsys.readouterr()
    assert cli.main([str(f), "101", "auditor", "json"], spark) == cli.OK
    report = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert list(report) == ["artifact", "language", "mode", "task", "rules_run", "findings_count", "graph_rendered", "duration_ms"]
    assert (report["language"], report["rules_run"], report["findings_count"], report["graph_rendered"]) == ("c", ["101"], 1, False)
    assert cli.main([str(f), "102"], spark) == cli.OK and "No findings." in capsys.readouterr().out
