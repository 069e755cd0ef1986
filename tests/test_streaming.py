"""Status as a stream: state that survives a restart, repeated and late events, expiry."""

from datetime import datetime, timedelta

from foliant.streaming import files, status

DAY = datetime(2024, 1, 1)
KINDS = ["view", "click"]
EVENT = "id long, stem string, time timestamp, kind string"


def run(spark, at, rows, **how):
    spark.createDataFrame([(k, s, DAY + timedelta(hours=h), kind) for k, s, h, kind in rows], EVENT).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = files.arriving(spark, f"{at}/in", EVENT, per_trigger=1)
    status.persist(status.job_counts(stream, KINDS, **how), f"{at}/out", f"{at}/state").awaitTermination(120)
    return {r["stem"]: (r["view"], r["click"], r["total"], (r["last"] - DAY).total_seconds() / 3600, r["expired"]) for r in status.current(spark, f"{at}/out").collect()}


def test_restarts_repeats_and_late_events(spark, tmp_path):
    at = str(tmp_path)
    assert run(spark, at, [(1, "a", 1, "view"), (2, "a", 2, "click"), (3, "b", 2, "other"), (4, None, 2, "view")], late="3 hours") == {"a": (1, 1, 2, 2.0, False), "b": (0, 0, 1, 2.0, False), None: (1, 0, 1, 2.0, False)}
    assert run(spark, at, [(1, "a", 1, "view"), (5, "a", 0, "view"), (6, "b", 30, "view")], late="3 hours") == {"a": (2, 1, 3, 2.0, False), "b": (1, 0, 2, 30.0, False), None: (1, 0, 1, 2.0, False)}
    after = run(spark, at, [(7, "a", 3, "view"), (8, "b", 31, "click")], late="3 hours")  # 7 is a day late
    assert after["a"] == (2, 1, 3, 2.0, False) and after["b"] == (1, 1, 3, 31.0, False)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    at = str(tmp_path)
    first = run(spark, at, [(1, "a", 1, "view"), (2, "a", 2, "view")])
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    (tmp_path / "state" / "commits" / str(last)).unlink()  # as if the driver had died before the batch was noted
    for crc in (tmp_path / "state" / "commits").glob(f".{last}.crc"):
        crc.unlink()
    assert run(spark, at, [(3, "b", 3, "view")]) == {**first, "b": (1, 0, 1, 3.0, False)}


def test_idle_jobs_expire(spark, tmp_path):
    at = str(tmp_path)
    run(spark, at, [(1, "a", 1, "view"), (2, "b", 1, "view")], late="1 hour", idle_ms=10 * 3600 * 1000)
    run(spark, at, [(3, "b", 40, "view")], late="1 hour", idle_ms=10 * 3600 * 1000)
    got = run(spark, at, [(4, "b", 41, "view")], late="1 hour", idle_ms=10 * 3600 * 1000)
    assert got["a"][-1] and not got["b"][-1]
    again = run(spark, at, [(5, "a", 42, "click")], late="1 hour", idle_ms=10 * 3600 * 1000)
    assert again["a"] == (0, 1, 1, 42.0, False)
    status.compact(spark, f"{at}/out", f"{at}/small")
    assert {r["stem"] for r in status.current(spark, f"{at}/small").collect()} == {"a", "b"}
