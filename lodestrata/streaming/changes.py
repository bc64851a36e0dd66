"""Change feeds and windows with Structured Streaming; the windows run alike on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import VersionedTable, merge
from ..plans.registry import Registry
from ..session import table

R = Registry()
CHANGE = "id long, op string, key long, doc string"


def change_stream(spark: SparkSession, path: str, ops: list[str] | None = None, schema: str = CHANGE, files_per_batch: int = 100) -> DataFrame:
    """ST-01: change records that land as JSON files, of the given operations."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return s if ops is None else s.where(F.col("op").isin(ops))


def follow(stream: DataFrame, handle, checkpoint: str, once: bool = True):
    """ST-02, ST-03: hands each micro-batch to handle(df, number); the checkpoint is the resume token."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w).start()
    if once:
        q.awaitTermination()
    return q


def merge_stream(stream: DataFrame, target: VersionedTable, keys: list[str], checkpoint: str, delete_op: str = "delete", order: str = "id") -> None:
    """ST-06: each micro-batch's last change of each key merged into the target as a new version."""
    from ..operators.rewrites import distinct_on

    def handle(batch: DataFrame, number: int) -> None:
        last = distinct_on(batch, keys, [F.desc(order)])
        gone = last.where(F.col("op") == delete_op).select(*keys)
        new = last.where(F.col("op") != delete_op)

        def make(old):
            if old is None:
                return new.drop("op", order)
            m = merge(old, new.drop("op", order), keys, update_if="true", insert_if="true").drop("action")
            return m.join(gone, keys, "left_anti")

        target.write(make, "STREAM MERGE")

    follow(stream, handle, checkpoint)


def tumbling(df: DataFrame, ts: str, every: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of value by event-time window; streams need a watermark (late)."""
    d = df.withWatermark(ts, late) if late and df.isStreaming else df
    return d.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), *keys, "n", "v")


def sliding(df: DataFrame, ts: str, length: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late and df.isStreaming else df
    return d.groupBy(F.window(ts, length, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late and df.isStreaming else df
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.min(ts).alias("first")).select(key, "first", "n")


def capped_by_user(df: DataFrame, keep: int = 50) -> DataFrame:
    """ST-08 on a stream or table: each user's last values, by order of event, as state of bounded size."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        now = list(state.get[0]) if state.exists else []
        for b in batches:
            now += [int(x) for x in b.sort_values(["ts", "event_id"])["event_id"]]
        now = now[-keep:]
        state.update((now,))
        yield pd.DataFrame({"user_id": [key[0]], "ids": [now]})

    return df.groupBy("user_id").applyInPandasWithState(run, "user_id long, ids array<long>", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


@R.query("st_tumbling", "ST windows", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS STRING) AS start, event_type, count(*) AS n, CAST(round(CAST(sum(value) AS DECIMAL(38,12)), 4) AS DOUBLE) AS v FROM events GROUP BY 1, 2")
def _(spark, d):
    from ..operators.rewrites import decimal

    t = tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"])
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", decimal("v", 4).alias("v"))


@R.query("st_sliding", "ST windows", "SELECT CAST(s AS STRING) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) t GROUP BY 1, 2")
def _(spark, d):
    return sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@R.query("st_sessions", "ST windows", "SELECT user_id, count(*) AS n, CAST(min(ts) AS STRING) AS first FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events) t) u GROUP BY user_id, s".replace("CAST(min(ts) AS STRING)", "strftime(min(ts), '%Y-%m-%d %H:%M:%S')"))
def _(spark, d):
    return sessions(table(spark, d, "events"), "ts", "6 hours", "user_id").select("user_id", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"))


@R.query("st_change_filter", "ST-01", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup")).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
