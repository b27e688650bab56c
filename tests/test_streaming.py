import time

from arboria.streaming import watch


def test_a_changed_file_is_reported_again(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "old.py").write_text("a = 1\n")
    said = []
    q = watch.watch(spark, str(src), lambda paths: {"n": len(paths)}, str(tmp_path / "cp"), 0.3, said.append)
    try:
        for text in ("b = 1\n", "b = 2\n"):
            before = len(said)
            time.sleep(1.2)
            (src / "new.py").write_text(text)
            for _ in range(80):
                time.sleep(0.25)
                if len(said) > before:
                    break
        assert [x["paths"] for x in said] == [["new.py"], ["new.py"]] and all("error" not in x for x in said)
    finally:
        q.stop()


def test_a_failure_does_not_end_the_watch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    said = []

    def ingest(paths):
        raise ValueError("bad file")

    q = watch.watch(spark, str(src), ingest, str(tmp_path / "cp"), 0.3, said.append)
    try:
        time.sleep(1.2)
        (src / "new.py").write_text("x\n")
        for _ in range(80):
            time.sleep(0.25)
            if said:
                break
        assert "bad file" in said[0]["error"] and q.isActive
    finally:
        q.stop()


def test_bursts_are_one_change(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:09"), ("b", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "rel string, at string").selectExpr("rel", "timestamp(at) at")
    got = sorted((r.rel, r.at.second) for r in watch.debounced(df, "rel", "at", 3).collect())
    assert got == [("a", 1), ("a", 9), ("b", 0)]
