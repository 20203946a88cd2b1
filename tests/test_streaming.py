import json

from sextant.streaming import live


def test_live_states(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ev = lambda t, action, test: json.dumps({"Time": f"2024-01-01T00:{t:02d}:00Z", "Action": action, "Package": "p", "Test": test, "Elapsed": 0.5})
    (folder / "a.txt").write_text("\n".join([ev(1, "run", "A"), ev(2, "fail", "A"), ev(3, "pass", "B"), "noise", "{broken"]))
    events = live.event_stream(spark, str(folder))
    q = live.test_states(events).writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        (folder / "b.txt").write_text(ev(4, "pass", "A"))
        q.processAllAvailable()
        assert {(r["test"], r["status"]) for r in spark.sql("SELECT * FROM states").collect()} == {("A", "pass"), ("B", "pass")}
    finally:
        q.stop()
    counts = live.outcome_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).start()
    try:
        counts.processAllAvailable()
        assert [(r["pass"], r["fail"], r["skip"]) for r in spark.sql("SELECT * FROM counts").collect()] == [(2, 1, 0)]
    finally:
        counts.stop()
