from datetime import datetime

from coredust.streaming import timeline


def test_windows_are_final_once(spark, tmp_path):
    day = lambda d, h: datetime(2024, 1, d, h, 30)
    rows = [("a", "x", "Created", day(1, 1)), ("a", "y", "Created", day(1, 1)), ("b", "z", "Created", day(1, 2)), ("a", "end", "Created", day(9, 1))]
    spark.createDataFrame(rows, timeline.SCHEMA).write.parquet(str(tmp_path / "in"))
    counts = timeline.window_counts(timeline.read_events(spark, str(tmp_path / "in")))
    for _ in range(2):
        timeline.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = sorted((r.window_start.hour, r.plugin, r.n_rows) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a", 2), (2, "b", 1)]
