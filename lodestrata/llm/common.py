"""What the operators share: shared-folder tables, hashes, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def tune(spark: SparkSession) -> None:
    """Workers get the package, and Arrow batches of at most 1,000 rows and 4 MiB: texts are long."""
    ship(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows, "10000")) > 1000:
        spark.conf.set(rows, "1000")
    spark.conf.set(size, str(4 << 20))


def tidy() -> None:
    """Give memory that a worker has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder; a new one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def fresh(columns, *names: str) -> list[str]:
    """Column names like these that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and reread it: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by materialize() that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        with contextlib.suppress(Exception):
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def arrow_uri(path: str) -> str:
    """Hadoop writes file:/x where Arrow wants file:///x; a bare path is a local one."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:") :]
    return path if "://" in path else "file://" + path


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bit_table(ids: DataFrame, n: int | None = None, max_bits: int = 1 << 27):
    """A bit for the hash of each id (a table with one long column id; n: about how many), in at most max_bits bits: what
    may be sent to all workers however many ids there are. Where it fills up, more ids seem to be in it than are."""
    import numpy as np

    bits, n = 1 << 16, ids.count() if n is None else n
    while bits < min(max_bits, 32 * n):
        bits *= 2
    at = ids.select(F.xxhash64("id").alias("h"))
    got = at.groupBy(F.shiftright(F.col("h").bitwiseAND(F.lit(bits - 1)), 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def may_be_in(df: DataFrame, table) -> DataFrame:
    """The rows of df whose id may be in a bit table; no id of the table is lost, and nothing is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(table)
    hashed = df.withColumn("_h", F.xxhash64("id"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = sent.value
        for b in batches:
            h = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(len(bits) * 64 - 1)
            on = (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) != 0
            if on.any():
                yield b.filter(pa.array(on)).select(list(range(b.num_columns - 1)))

    return hashed.mapInArrow(run, df.schema)


#: Edges that one task contracts, on average.
CONTRACT_EDGES = 1 << 20


def forest(u, v):
    """Edges (arrays) with the same components, as (node, smallest node) of each node that isn't the smallest."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    on = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[on], nodes[low[on]]


def _contract(batches, most: int = 1 << 20):
    """The forests of one task's edges (u, v); at most about `most` edges are held at a time."""
    import numpy as np
    import pyarrow as pa

    def out(u, v):
        for k in range(0, len(u), 1 << 16):
            yield pa.record_batch([pa.array(x[k : k + (1 << 16)]) for x in (u, v)], names=["u", "v"])

    u, v, more, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for b in batches:
        more.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        held += b.num_rows
        if held >= most:
            u, v = forest(*(np.concatenate(x) for x in zip((u, v), *more)))
            more, held = [], 0
            if len(u) >= most // 2:
                yield from out(u, v)
                u, v = u[:0], v[:0]
    if more:
        u, v = forest(*(np.concatenate(x) for x in zip((u, v), *more)))
    yield from out(u, v)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph given as (a long, b long): (node, component = smallest node reachable).

    Each task first contracts the edges that it has, about 2^20 of them, so small graphs need no more. While nodes still have several neighbours, rounds of large stars
    and small stars follow: every step is a partially aggregated minimum per node joined back to the edges, so a hub's
    edges are never gathered in one task. Each round is written to the shared folder. Null ends and self loops are
    ignored; no edges give no rows.
    """

    def contract(batches):
        yield from _contract(batches)

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("k"), F.lit(1).alias("n"), F.lit(False).alias("root")).unionByName(e.select(F.col("v").alias("k"), F.lit(0).alias("n"), F.lit(True).alias("root")))
        return ends.groupBy("k").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n > 1 or n > 0 and root").isEmpty()

    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    raw, raw_at = materialize(e, "edges")
    tasks = -(-raw.count() // CONTRACT_EDGES)
    e, path = materialize(raw.coalesce(max(1, tasks)).mapInArrow(contract, "u long, v long"), "edges")
    forget(spark, raw_at)
    for _ in range(max_rounds):
        if tasks <= 1 or settled(e):
            break
        n = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = n.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hop.unionByName(least.select("u", F.col("m").alias("v")))
        new, new_at = materialize(small.mapInArrow(contract, "u long, v long"), "edges")
        forget(spark, path)
        e, path = new, new_at
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.distinct().select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
