from quarry.operators.history import History
from quarry.streaming.ingest import ingest_stream


def test_new_files_are_taken_once(spark, tmp_path):
    folder, root, checkpoint = (str(tmp_path / x) for x in ("in", "h", "c"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.c").write_text("int a;")
    for _ in range(2):
        ingest_stream(spark, folder, root, checkpoint).awaitTermination()
    (tmp_path / "in" / "b.rs").write_text("fn b() {}")
    (tmp_path / "in" / "c.c").write_text("int a;")
    ingest_stream(spark, folder, root, checkpoint).awaitTermination()
    assert sorted(r.filename for r in History(spark, root).artifacts.collect()) == ["a.c", "b.rs"]
