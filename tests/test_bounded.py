"""Sessions of a stream with timers: restart, late files, state of bounded size."""

from collections import defaultdict

from pyspark.sql import functions as F

from lodestrata.session import scratch
from lodestrata.streaming import bounded


def land(spark, folder, rows):
    df = spark.createDataFrame([(u, e, t) for u, t, e in rows], "user_id long, event_id long, s long")
    df.select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    return "user_id long, event_id long, ts timestamp"


def expected(rows, gap, keep, end):
    by = defaultdict(list)
    for u, t, e in rows:
        by[u].append((t, e))
    out = []
    for u, events in by.items():
        events.sort()
        runs = [[events[0]]]
        for x in events[1:]:
            (runs.append([x]) if x[0] - runs[-1][-1][0] > gap else runs[-1].append(x))
        out += [(u, 1000 * r[0][0], 1000 * r[-1][0], len(r), [e for _, e in r[-keep:]]) for k, r in enumerate(runs) if k < len(runs) - 1 or r[-1][0] + gap <= end]
    return sorted(out, key=str)


def test_restart(spark):
    folder, out, progress = (scratch(spark, x) for x in ("in", "out", "progress"))
    first = [(1, 100, 1), (1, 130, 2), (2, 110, 3), (None, 120, 4), (1, 140, 5), (1, 150, 6), (1, 400, 7)]
    second = [(2, 420, 8), (1, 440, 9), (3, 900, 10), (4, 2000, 11)]
    schema = land(spark, folder, first)
    bounded.run_sessions(spark, folder, out, progress, 60, 3, schema)
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    assert got == expected(first, 60, 3, 400)
    assert (1, 100_000, 150_000, 4, [2, 5, 6]) in got, "the last three of a session"
    land(spark, folder, second)
    bounded.run_sessions(spark, folder, out, progress, 60, 3, schema)
    assert sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str) == expected(first + second, 60, 3, 2000)
    bounded.run_sessions(spark, folder, out, progress, 60, 3, schema)
    assert spark.read.parquet(out).count() == len(expected(first + second, 60, 3, 2000)), "nothing is read twice"
