"""A stored inverted file over vectors: lists as partitions, centroids beside them, exact and approximate search.

``build_lists`` fits centroids to a bounded sample of rows (their number grows as the square root of the rows), assigns every
row to its nearest, and writes the rows packed into blocks of at most ``BLOCK_BYTES``, so a hot list is many blocks. The
blocks are partitioned by list; a search reads the partitions and, by page statistics, the lists that it probes.

The number of probes is measured, not guessed: a sample of stored vectors is searched exactly, and the fewest probes that
would have found ``recall`` of their nearest vectors are stored. ``search`` probes so many lists for each query; an exact search
takes those distances as bounds and then reads all lists whose centroid less their radius may be nearer.

New rows are added to the lists as they are; once the table has grown ``factor`` times, ``maintain`` builds it again.

Distances are cosine distances (1 - cosine) of unit vectors, or L2. Defined results: vectors that are null, empty, hold
null or non-finite components, have another dimension than most, or are zero (cosine) are not indexed and find nothing;
ties go by key; a table without vectors has no lists and finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import scratch, ship, table
from .ordered import GlobalOrder
from .rewrites import decimal, top_per_group

R = Registry()
#: Bytes of a block of vectors, and of all centroids (which are sent to all tasks).
BLOCK_BYTES, CENTROID_BYTES = 4 << 20, 64 << 20
#: Rows to a list that centroids are fitted to, and the most of them.
SAMPLE_OF_LIST, SAMPLE_ROWS = 64, 1 << 18
#: Stored vectors that are searched exactly to choose the number of probes.
TRIALS = 128
#: Folders that lists are dealt to.
FOLDERS = 128
#: Queries that meet a block at a time.
QUERY_BLOCK = 256


@dataclass
class Lists:
    """Where an inverted file is and what it holds."""

    path: str
    key: str
    vector: str
    metric: str
    dim: int
    lists: int
    rows: int
    fitted_rows: int
    generation: int
    probes: int
    recall: float
    kind: str

    def stale(self, rows: int, factor: float = 3) -> bool:
        """DML-17: whether the table has so many times the rows that centroids were fitted for."""
        return rows >= factor * max(1, self.fitted_rows)

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks").where(F.col("generation") <= self.generation)

    def centers(self, spark: SparkSession):
        """(matrix of centroids, radius of each list): lists rows, at most CENTROID_BYTES."""
        import numpy as np

        c = spark.read.parquet(f"{self.path}/centers").orderBy("list").toPandas()
        r = spark.read.parquet(*[f"{self.path}/radii-{g}" for g in range(self.generation + 1)]).groupBy("list").agg(F.max("radius").alias("radius")).toPandas()
        radius = np.full(self.lists, -1.0)  # a list without rows
        radius[r["list"].to_numpy(np.int64)] = r["radius"]
        return np.array(c["centroid"].tolist(), float).reshape(self.lists, self.dim), radius

    def search(self, queries: DataFrame, k: int, probes: int | None = None, others: bool = False) -> DataFrame:
        """(query, neighbour, distance, rank) of the k nearest rows among the probed lists, for rows (query, vector); others: rows
        with the query's own key are no neighbours."""
        spark = queries.sparkSession
        ship(spark)
        if not self.lists:
            return _nothing(queries, self.kind)
        sent = spark.sparkContext.broadcast(self.centers(spark))
        asked = _choose(self._unit(queries, "query", "vector"), sent, self.probes if probes is None else probes)
        return self._answer(asked, k, others)

    def search_exact(self, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
        """The same over all rows: lists are left out only where the k-th distance found so far says that they may be."""
        spark = queries.sparkSession
        ship(spark)
        if not self.lists:
            return _nothing(queries, self.kind)
        sent = spark.sparkContext.broadcast(self.centers(spark))
        unit = _written(self._unit(queries, "query", "vector"), "queries")
        first = self._answer(_choose(unit, sent, self.probes), k, others)
        worst = _written(first.where(F.col("rank") == k).select(F.col("query").alias("_q"), F.col("distance").alias("worst")), "worst")
        far = unit.join(worst, unit["query"].eqNullSafe(worst["_q"]), "left").select("query", "vector", "worst")
        return self._answer(_choose(far, sent, None, self.metric), k, others)

    def _unit(self, df: DataFrame, key: str, vector: str) -> DataFrame:
        return _valid(df, key, vector, self.dim, self.metric)

    def _answer(self, asked: DataFrame, k: int, others: bool) -> DataFrame:
        """Blocks of queries meet the blocks of their lists."""
        spark = asked.sparkSession
        kind = asked.schema["query"].dataType.simpleString()
        asked = _written(asked, "asked")
        size = asked.groupBy("list").agg(F.count("*").alias("n"))
        dealt = asked.join(size, "list").withColumn("part", F.pmod(F.xxhash64("query"), F.ceil(F.col("n") / QUERY_BLOCK)))
        packed = dealt.groupBy("list", "part").applyInArrow(_pack("query", "vector"), f"list long, part long, keys array<{kind}>, vectors binary")
        packed = packed.select("list", F.col("keys").alias("queries"), F.col("vectors").alias("asked"))
        wanted = self.blocks(spark)
        few = [r["list"] for r in asked.select("list").distinct().limit(65).collect()]
        if len(few) <= 64:  # as filters, so that other partitions are not read
            wanted = wanted.where(F.col("list").isin(few) & F.col("folder").isin(sorted({x % FOLDERS for x in few})))
        own = self.kind
        met = packed.join(wanted.select("list", "keys", "vectors"), "list").select("queries", "asked", "keys", "vectors")
        found = met.mapInArrow(_nearest(self.dim, self.metric, k, others), f"query {kind}, neighbour {own}, distance double")
        out = top_per_group(found, ["query"], [F.asc("distance"), F.asc("neighbour")], k)
        return out.select("query", "neighbour", "distance", F.col("rn").alias("rank"))


def _nothing(queries: DataFrame, kind: str) -> DataFrame:
    return queries.select("query", F.lit(None).cast(kind).alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _valid(df: DataFrame, key: str, vector: str, dim: int | None, metric: str) -> DataFrame:
    """(key, vector) in double precision, unit vectors for cosine; only those that have a place (dim None: of any dimension)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            v = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            for n in [dim] if dim else np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                if not len(at):
                    continue
                x = np.asarray(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, int(n))  # nulls are NaN
                on = np.isfinite(x).all(1)
                if metric == "cosine":
                    largest = np.abs(np.where(np.isfinite(x), x, 0)).max(1)
                    on &= largest > 0
                    x = x[on] / largest[on, None]  # no square overflows
                    x /= np.sqrt((x * x).sum(1))[:, None]
                else:
                    x = x[on]
                at = at[on]
                for k in range(0, len(at), 4096):
                    part = x[k : k + 4096]
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * int(n))
                    yield pa.record_batch([b.column(0).take(pa.array(at[k : k + 4096])), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], names=[key, "vector"])

    source = df.select(F.col(key).alias(key), F.col(vector).cast("array<double>").alias("vector"))
    return source.mapInArrow(run, f"`{key}` {kind}, vector array<double>")


def _matrix(column):
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, float).reshape(len(column), -1)


def _choose(queries: DataFrame, sent, probes: int | None, metric: str = "cosine") -> DataFrame:
    """(list, query, vector): the nearest lists of each query, or, of (query, vector, worst), all that may hold a nearer row."""
    kind = queries.schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centers, radius = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                x = _matrix(part.column(1))
                far = np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T, 0)
                far[:, radius < 0] = np.inf
                if probes is None:
                    worst = part.column(2).to_numpy(zero_copy_only=False)
                    reach = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(2 * worst, 0)) if metric == "cosine" else worst)
                    on = (np.sqrt(far) - radius <= reach[:, None] * (1 + 1e-9) + 1e-6) & (radius >= 0)
                    row, at = np.nonzero(on)
                else:
                    n = min(probes, int((radius >= 0).sum()))
                    at = np.argsort(far, axis=1, kind="stable")[:, :n].ravel()
                    row = np.repeat(np.arange(len(x)), n)
                for k in range(0, len(row), 4096):
                    s = slice(k, k + 4096)
                    yield pa.record_batch([pa.array(at[s].astype(np.int64)), part.column(0).take(pa.array(row[s])), part.column(1).take(pa.array(row[s]))], names=["list", "query", "vector"])

    return queries.mapInArrow(run, f"list long, query {kind}, vector array<double>")


def _pack(key: str, vector: str):
    """A group of rows of one list and part as one row."""

    def run(t):
        import numpy as np
        import pyarrow as pa

        x = _matrix(pa.concat_arrays(t[vector].chunks))
        keys = pa.concat_arrays(t[key].chunks)
        return pa.table({"list": t["list"].slice(0, 1), "part": t["part"].slice(0, 1), "keys": pa.array([keys.to_pylist()], pa.list_(keys.type)), "vectors": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

    return run


def _nearest(dim: int, metric: str, k: int, others: bool):
    """The k nearest of each block's rows for each of the queries that meet it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                queries, keys = b.column(0)[i].values, b.column(2)[i].values
                q, x = (np.frombuffer(b.column(c)[i].as_py(), float).reshape(-1, dim) for c in (1, 3))
                if metric == "cosine":
                    far = 1 - q @ x.T
                elif metric == "inner":
                    far = -(q @ x.T)
                else:
                    far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T, 0))
                if others:
                    for r in range(len(queries)):
                        far[r, _equal(keys, queries[r])] = np.inf
                n = min(k, far.shape[1])
                # ties of the last place stay: their keys decide later
                last = np.partition(far, n - 1, axis=1)[:, n - 1]
                row, at = np.nonzero((far <= last[:, None] + 1e-12) & np.isfinite(far))
                if len(row):
                    yield pa.record_batch([queries.take(pa.array(row)), keys.take(pa.array(at)), pa.array(far[row, at])], names=["query", "neighbour", "distance"])

    return run


def _equal(keys, own):
    import pyarrow.compute as pc

    return pc.fill_null(pc.equal(keys, own), False).to_numpy(zero_copy_only=False)


def _store(spark: SparkSession, rows: DataFrame, index: Lists, sent) -> int:
    """Assign rows (key, vector) to lists and write them as a generation; how many there were."""
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centers = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                x = _matrix(part.column(1))
                far = np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T, 0)
                at = far.argmin(1)
                yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(np.sqrt(far[np.arange(len(x)), at])), part.column(0), part.column(1)], names=["list", "far", "key", "vector"])

    placed = _written(rows.mapInArrow(run, f"list long, far double, key {kind}, vector array<double>"), "placed")
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    sizes = _written(sizes, "sizes")
    most = max(1, BLOCK_BYTES // (8 * index.dim))
    dealt = placed.join(F.broadcast(sizes.drop("radius")), "list").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / most)))  # a row for each list
    packed = dealt.groupBy("list", "part").applyInArrow(_pack("key", "vector"), f"list long, part long, keys array<{kind}>, vectors binary")
    packed.withColumn("folder", F.pmod("list", F.lit(FOLDERS)).cast("int")).repartition("folder").sortWithinPartitions("folder", "list", "part").write.partitionBy("folder").parquet(f"{index.path}/blocks/generation={index.generation}")
    sizes.coalesce(1).write.parquet(f"{index.path}/radii-{index.generation}")
    return sizes.agg(F.sum("n")).first()[0] or 0


def _fit(sample: DataFrame, lists: int, dim: int):
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=lists, seed=1, maxIter=10).fit(sample.select(array_to_vector("vector").alias("features")))
    return np.array([list(c) for c in model.clusterCenters()], float).reshape(-1, dim)


def build_lists(df: DataFrame, key: str = "vec_id", vector: str = "embedding", path: str | None = None, metric: str = "cosine", lists: int | None = None, recall: float = 0.95, k: int = 10) -> Lists:
    """V-05: write an inverted file over (key, vector) and choose its number of probes for the k nearest."""
    spark = df.sparkSession
    ship(spark)
    path, kind = path or scratch(spark, "lists"), df.schema[key].dataType.simpleString()
    usual = _valid(df, key, vector, None, metric).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return Lists(path, key, vector, metric, 0, 0, 0, 0, 0, 0, 1.0, kind)
    dim, rows = usual["dim"], usual["count"]
    n = min(lists or max(1, round(rows**0.5)), CENTROID_BYTES // (8 * dim), rows)
    valid = _valid(df, key, vector, dim, metric)
    share = min(1.0, min(SAMPLE_ROWS, max(4096, SAMPLE_OF_LIST * n)) / rows)
    sample = valid.where(F.pmod(F.xxhash64(key, "vector"), F.lit(1 << 30)) < int(share * (1 << 30)))
    centers = _fit(sample, n, dim)
    index = Lists(path, key, vector, metric, dim, len(centers), rows, rows, 0, len(centers), 1.0, kind)
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list long, centroid array<double>").coalesce(1).write.parquet(f"{path}/centers")
    _store(spark, valid, index, spark.sparkContext.broadcast(centers))
    index = _measure(spark, index, valid, recall, k)
    _note(spark, index)
    return index


def _note(spark: SparkSession, index: Lists) -> None:
    names = list(index.__dataclass_fields__)
    spark.createDataFrame([tuple(getattr(index, n) for n in names)], names).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/stats-{index.generation}")


def open_lists(spark: SparkSession, path: str, generation: int = 0) -> Lists:
    return Lists(**spark.read.parquet(f"{path}/stats-{generation}").first().asDict())


def _measure(spark: SparkSession, index: Lists, valid: DataFrame, recall: float, k: int) -> Lists:
    """The fewest probes that find so much of the k nearest of TRIALS stored vectors, and what they find."""
    import numpy as np

    centers, radius = index.centers(spark)
    own = F.xxhash64(index.key, F.lit(7))
    trials = valid.where(F.col(index.key).isNotNull()).select(F.col(index.key).alias("query"), "vector").orderBy(own).limit(TRIALS)
    trials = _written(trials, "trials")
    near = replace(index, probes=index.lists).search(trials, k, others=True)
    where = index.blocks(spark).select("list", F.explode("keys").alias("neighbour"))
    found = near.join(where, "neighbour").select("query", "list").toPandas()  # TRIALS times k rows
    asked = {r["query"]: np.array(r["vector"]) for r in trials.collect()}
    place = []
    for query, own_list in zip(found["query"], found["list"]):
        far = ((centers - asked[query]) ** 2).sum(1)
        far[radius < 0] = np.inf
        place.append(int((far < far[int(own_list)]).sum()))
    if not place:
        return index
    place = np.sort(np.array(place))
    probes = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
    return replace(index, probes=probes, recall=float((place < probes).mean()))


def add_rows(index: Lists, rows: DataFrame) -> Lists:
    """The index with more rows, as a generation of its own: centroids stay, lists and radii grow."""
    spark = rows.sparkSession
    new = replace(index, generation=index.generation + 1)
    centers, _ = index.centers(spark)
    n = _store(spark, index._unit(rows, index.key, index.vector), new, spark.sparkContext.broadcast(centers))
    new = replace(new, rows=index.rows + n)
    _note(spark, new)
    return new


def maintain(index: Lists, every: DataFrame, added: DataFrame, factor: float = 3) -> tuple[Lists, bool]:
    """DML-17: the index after rows were added: built again from all rows if it is stale, else with one more generation."""
    if not index.lists or index.stale(every.count(), factor):
        return build_lists(every, index.key, index.vector, metric=index.metric), True
    return add_rows(index, added), False


# Largest inner products ------------------------------------------------------------------------------------------

#: Blocks of items whose largest norms are sent to all tasks (a number each).
SENT_BLOCKS = 1 << 20


def top_products(users: DataFrame, items: DataFrame, k: int, others: bool = False) -> DataFrame:
    """V-10: (user, item, score, rank): the exact k items of largest inner product of each user, for rows (user, v), (item, v).

    Items are in order of falling norm, in blocks of at most BLOCK_BYTES. Users first meet the leading block; their k-th
    score so far over their own norm says up to which block an item may still be better (Cauchy and Schwarz), and they meet
    the blocks up to there. Vectors without a place score nothing; ties go by item."""
    import numpy as np

    spark = items.sparkSession
    ship(spark)
    usual = _valid(items, "item", "v", None, "inner").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((users, "user"), (items, "item"))]
    schema = f"user {kinds[0]}, item {kinds[1]}, score double, rank int"
    if usual is None or k < 1:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    size = max(1, BLOCK_BYTES // (8 * dim))
    order = GlobalOrder(_valid(items, "item", "v", dim, "inner").withColumn("norm", norm), ["-norm", "item"]).numbered("row")
    dealt = order.withColumns({"list": F.expr(f"(row - 1) div {size}"), "part": F.lit(0).cast("long")})
    packed = dealt.groupBy("list", "part").applyInArrow(_pack("item", "vector"), f"list long, part long, keys array<{kinds[1]}>, vectors binary")
    packed = _written(packed.select("list", "keys", "vectors"), "items")
    tops = dealt.groupBy("list").agg(F.max("norm").alias("norm")).orderBy("list").limit(SENT_BLOCKS + 1).collect()
    if len(tops) > SENT_BLOCKS:
        raise ValueError(f"more than {SENT_BLOCKS} blocks of items: raise BLOCK_BYTES")
    sent = spark.sparkContext.broadcast(np.array([r["norm"] for r in tops]))
    own = _written(_valid(users, "user", "v", dim, "inner").withColumn("norm", norm), "users")

    def answer(asked: DataFrame) -> DataFrame:
        n = asked.groupBy("list").agg(F.count("*").alias("n"))
        mine = asked.join(n, "list").withColumn("part", F.pmod(F.xxhash64("user"), F.ceil(F.col("n") / QUERY_BLOCK)))
        mine = mine.groupBy("list", "part").applyInArrow(_pack("user", "vector"), f"list long, part long, keys array<{kinds[0]}>, vectors binary")
        met = mine.select("list", F.col("keys").alias("queries"), F.col("vectors").alias("asked")).join(packed, "list").select("queries", "asked", "keys", "vectors")
        found = met.mapInArrow(_nearest(dim, "inner", k, others), f"user {kinds[0]}, item {kinds[1]}, distance double".replace("user", "query").replace("item", "neighbour"))
        return found.select(F.col("query").alias("user"), F.col("neighbour").alias("item"), (-F.col("distance")).alias("score"))

    first = _written(top_per_group(answer(own.select(F.lit(0).cast("long").alias("list"), "user", "vector")), ["user"], [F.desc("score"), F.asc("item")], k), "best")
    least = first.where(F.col("rn") == k).select(F.col("user").alias("_u"), F.col("score").alias("least"))

    def reach(batches):
        import pyarrow as pa

        for b in batches:
            n, worst = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                bar = np.where(np.isnan(worst), -np.inf, worst * (1 - np.sign(worst) * 1e-9) - 1e-12)
                bar = np.where(n > 0, bar / n, np.where(bar < 0, -np.inf, np.inf))
            ends = np.searchsorted(-sent.value, -bar, side="right")  # blocks before hold norms of at least the bar
            yield pa.record_batch([b.column(0), pa.array(ends.astype(np.int64))], names=["user", "ends"])

    ends = own.join(least, own["user"].eqNullSafe(least["_u"]), "left").select("user", "norm", "least").mapInArrow(reach, f"user {kinds[0]}, ends long")
    further = own.select(F.col("user").alias("_u"), "vector").join(ends.where("ends > 1"), F.col("_u").eqNullSafe(F.col("user")))
    further = further.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("ends") - 1)).alias("list"), "user", "vector")
    every = first.drop("rn").unionByName(answer(further))
    return top_per_group(every, ["user"], [F.desc("score"), F.asc("item")], k).select("user", "item", "score", F.col("rn").alias("rank"))


# Queries ---------------------------------------------------------------------------------------------------------


def _queries(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


NEAREST_SQL = "SELECT a.vec_id AS query, b.vec_id AS neighbour, CAST(round(CAST(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DECIMAL(38,12)), 6) AS DOUBLE) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) <= 10"


@R.query("v_inverted_file", "V-05")
def _(spark, d):
    """The ten nearest of every vector whose id 50 divides, by the measured number of probes."""
    e = table(spark, d, "embeddings")
    out = build_lists(e).search(_queries(e), 10, others=True)
    return out.select("query", "neighbour", "distance", "rank")


@R.query("v_inverted_exact", "V-05", NEAREST_SQL)
def _(spark, d):
    """The same by an exact search that leaves lists out by their radius."""
    e = table(spark, d, "embeddings")
    return build_lists(e).search_exact(_queries(e), 10, others=True).select("query", "neighbour", decimal("distance", 6).alias("distance"))


@R.query("v_inverted_recall", "V-05", "SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, 10 * count(*) FILTER (WHERE vec_id % 50 = 0) AS neighbours, true AS enough FROM embeddings")
def _(spark, d):
    """The share of the ten nearest that the probed lists hold, against an exact search, is 0.9 or more."""
    e = table(spark, d, "embeddings")
    index = build_lists(e)
    exact = index.search_exact(_queries(e), 10, others=True).select("query", "neighbour")
    probed = index.search(_queries(e), 10, others=True).select("query", "neighbour", F.lit(1).alias("hit"))
    out = exact.join(probed, ["query", "neighbour"], "left").agg(F.countDistinct("query").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("hits"))
    return out.select("queries", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("enough"))


@R.query("v_inverted_grown", "DML-17 V-05", f"SELECT n.query, n.neighbour, n.distance, false AS rebuilt_first, true AS rebuilt_then FROM ({NEAREST_SQL}) n")
def _(spark, d):
    """A quarter of the vectors indexed, a quarter added to its lists, the rest a reason to build it again; exact search."""
    e = table(spark, d, "embeddings")
    index = build_lists(e.where("vec_id % 4 = 0"))
    index, first = maintain(index, e.where("vec_id % 4 < 2"), e.where("vec_id % 4 = 1"))
    index, then = maintain(index, e, e.where("vec_id % 4 > 1"))
    out = index.search_exact(_queries(e), 10, others=True)
    return out.select("query", "neighbour", decimal("distance", 6).alias("distance"), F.lit(first).alias("rebuilt_first"), F.lit(then).alias("rebuilt_then"))


def _customers(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("user"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))


PRODUCT_SQL = """best AS (SELECT a.vec_id AS "user", b.vec_id AS item, a.label = b.label AS hit, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) <= 10)"""


@R.query("v_top_products", "V-10", f"WITH {PRODUCT_SQL} SELECT \"user\", item, CAST(round(CAST(score AS DECIMAL(38,12)), 6) AS DOUBLE) AS score FROM best")
def _(spark, d):
    """The ten items of largest inner product of every vector whose id 50 divides, among all others."""
    return top_products(*_customers(spark, d), 10, others=True).select("user", "item", decimal("score", 6).alias("score"))


@R.query("v_recall_at_10", "V-10", f"WITH {PRODUCT_SQL}, n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY 1), u AS (SELECT \"user\", count(*) FILTER (WHERE hit) AS hits FROM best GROUP BY 1) SELECT count(*) AS users, CAST(round(CAST(avg(CASE WHEN n.n > 0 THEN hits * 1.0 / least(10, n.n) END) AS DECIMAL(38,12)), 6) AS DOUBLE) AS recall FROM u JOIN embeddings e ON e.vec_id = u.\"user\" JOIN n ON n.label = e.label")
def _(spark, d):
    """Recall@10 where the relevant items of a vector are the others of its label."""
    e = table(spark, d, "embeddings")
    best = top_products(*_customers(spark, d), 10, others=True).select("user", "item")
    label = e.select(F.col("vec_id").alias("item"), F.col("label").alias("item_label"))
    users = e.select(F.col("vec_id").alias("user"), "label").join(e.groupBy("label").agg((F.count("*") - 1).alias("n")), "label")
    hits = best.join(label, "item").join(users, "user").groupBy("user", "n").agg(F.count_if(F.col("item_label") == F.col("label")).alias("hits"))
    return hits.agg(F.count("*").alias("users"), decimal(F.avg(F.try_divide("hits", F.least(F.lit(10), "n"))), 6).alias("recall"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
