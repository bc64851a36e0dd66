"""Bounded state of a stream with timers: each key's last values and its open session.

State is a list of at most ``keep`` values, the count of a session and its ends, held by buckets of keys; a session closes
when the next event of its key comes more than a gap later, or, if none comes, by a timer once the watermark has passed the
gap. Then the key's state is dropped, so what is held grows with the keys that are active, not with all that ever were. State
lives in the checkpoint: a query that is started again goes on where the last one ended.

Defined results: events of a key are taken in order of (time, id) within a micro-batch; those that are later than the
watermark are dropped by it; a null key is a key; null times are dropped; a session of one event has equal ends; what is still open
when the stream ends is not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import Registry
from ..session import scratch, ship, table

R = Registry()
SESSION = "user_id long, first long, last long, n long, ids array<long>"


class LastValues(StatefulProcessor):
    """Sessions (user_id, first, last, n, the last ids) of rows (bucket, user_id, no_user, at, event_id, no_event), at in
    milliseconds. The state of a bucket is the open sessions of its users, and one timer for the session that ends first."""

    def __init__(self, gap: int, keep: int):
        self.gap, self.keep = gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "user array<long>, first array<long>, last array<long>, n array<long>, ids array<array<long>>")

    def _held(self) -> dict:
        """By user: [first, last, n, ids]."""
        return {u: [first, last, n, list(ids)] for u, first, last, n, ids in zip(*self.open.get())} if self.open.exists() else {}

    def _hold(self, held: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not held:
            self.open.clear()
            return
        self.open.update((list(held), *(list(x) for x in zip(*held.values()))))
        self.handle.registerTimer(min(x[1] for x in held.values()) + self.gap)

    def _closed(self, closed: list):
        """A frame of (user, [first, last, n, ids])."""
        import pandas as pd

        users, rows = zip(*closed)
        df = pd.DataFrame(rows, columns=["first", "last", "n", "ids"])
        df.insert(0, "user_id", pd.array(users, "Int64"))  # with nulls by itself a column of doubles
        return df

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        held, closed = self._held(), []
        now = pd.concat(list(rows)).sort_values(["no_user", "user_id", "at", "no_event", "event_id"])
        at, user, none = (now[c].to_numpy() for c in ("at", "user_id", "no_user"))
        other = np.r_[True, (user[1:] != user[:-1]) | (none[1:] != none[:-1])]
        starts = np.flatnonzero(other | np.r_[True, at[1:] - at[:-1] > self.gap])
        ends = np.r_[starts[1:], len(at)]
        # each run of a user's events no more than a gap apart
        ids = [None if no else e for e, no in zip(now["event_id"].tolist(), now["no_event"].tolist())]
        users = [None if no else u for u, no in zip(user[starts].tolist(), none[starts].tolist())]
        for u, first, last, a, b in zip(users, at[starts].tolist(), at[ends - 1].tolist(), starts.tolist(), ends.tolist()):
            was = held.get(u)
            if was and (first <= was[1] + self.gap):
                # a late event may be followed, over a gap, by one that the session already reaches
                held[u] = [min(was[0], first), max(was[1], last), was[2] + b - a, [*was[3], *ids[a:b]][-self.keep :]]
                continue
            if was:
                closed.append((u, was))
            held[u] = [first, last, b - a, ids[max(a, b - self.keep) : b]]
        self._hold(held)
        if closed:
            yield self._closed(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held, end = self._held(), timerValues.getCurrentWatermarkInMs()
        closed = [(u, x) for u, x in held.items() if x[1] + self.gap <= end]
        self._hold({u: x for u, x in held.items() if x[1] + self.gap > end})
        if closed:
            yield self._closed(closed)

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap_seconds: int, keep: int, late: str = "0 seconds", buckets: int = 16) -> DataFrame:
    """ST-08: the sessions of a stream (user_id, ts, event_id) that are closed, each with its last ids. Users are dealt to
    buckets, as calls and state are paid by group; their number stays with a checkpoint."""
    ship(events.sparkSession)
    e = events.where("ts is not null").withWatermark("ts", late)
    zero = F.lit(0).cast("long")
    # flags, as a column of long with nulls would come as one of double
    e = e.select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), F.coalesce("user_id", zero).alias("user_id"), F.col("user_id").isNull().alias("no_user"), "ts", F.unix_millis("ts").alias("at"), F.coalesce("event_id", zero).alias("event_id"), F.col("event_id").isNull().alias("no_event"))
    return e.groupBy("bucket").transformWithStateInPandas(LastValues(1000 * gap_seconds, keep), SESSION, "Append", "EventTime")


def run_sessions(spark: SparkSession, folder: str, out: str, checkpoint: str, gap_seconds: int, keep: int, schema, late: str = "0 seconds", buckets: int = 16, files: int | None = 1) -> None:
    """All files of the folder that have not been read yet, so many a micro-batch in the order in which they were written (None:
    all in one); state and progress are in the checkpoint, closed sessions are appended to ``out``."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema)
        stream = (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(folder)
        closed = closed_sessions(stream, gap_seconds, keep, late, buckets)
        closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, old)


#: Events to a bucket of users of st_bounded_sessions.
BUCKET_ROWS = 1 << 17


SESSIONS_SQL = """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 21600000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
named AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked),
sessions AS (SELECT user_id, s, min(ms) AS first, max(ms) AS last, count(*) AS n, list(event_id ORDER BY ms, event_id) AS ids FROM named GROUP BY 1, 2)
SELECT user_id, first, last, n, array_to_string(ids[greatest(1, len(ids) - 2):], ',') AS ids FROM sessions
WHERE last + 21600000 <= (SELECT max(ms) FROM e) OR last < (SELECT max(y.last) FROM sessions y WHERE y.user_id = sessions.user_id)"""


@R.query("st_bounded_sessions", "ST-08", SESSIONS_SQL)
def _(spark, d):
    """Sessions of all events, read as a micro-batch of a time range each; after each the query is ended and started again."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    at = F.unix_millis("ts")
    lo, hi, n = e.agg(F.min(at), F.max(at), F.count("ts")).first()
    folder, out, checkpoint = (scratch(spark, x) for x in ("events", "sessions", "progress"))
    if lo is None:
        return spark.createDataFrame([], SESSION).withColumn("ids", F.array_join("ids", ","))
    step, buckets = (hi - lo) // 6 + 1, max(16, n // BUCKET_ROWS)
    for k in range(6):
        e.where((at >= lo + k * step) & (at < lo + (k + 1) * step)).write.mode("append").parquet(folder)
        run_sessions(spark, folder, out, checkpoint, 6 * 3600, 3, e.schema, buckets=buckets, files=None)
    ids = F.array_compact("ids")
    return spark.read.schema(SESSION).parquet(out).withColumn("ids", F.when(F.size(ids) > 0, F.array_join(ids.cast("array<string>"), ",")))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
