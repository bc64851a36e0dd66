"""Vector distances, exact nearest neighbours, centroids, coherence (the inverted file is in ``lists``).

Distances are expressions over arrays in double precision, so they stay in generated code and sort straight into a
top-k; a query vector is a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import table
from .rewrites import decimal, top_per_group

R = Registry()


def array_of(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, (list, tuple)) else (F.col(v) if isinstance(v, str) else v)


def dot(a, b) -> Column:
    x, y = array_of(a), array_of(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)


def cosine(a, b) -> Column:
    """V-01: similarity; 1 less it is the distance."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2(a, b) -> Column:
    """V-02."""
    return F.sqrt(F.aggregate(F.zip_with(array_of(a), array_of(b), lambda p, q: (p.cast("double") - q.cast("double")) ** 2), F.lit(0.0), lambda s, t: s + t))


def neg_inner(a, b) -> Column:
    """V-03."""
    return -dot(a, b)


METRICS = {"cosine": lambda a, b: 1 - cosine(a, b), "l2": l2, "ip": neg_inner}


def knn(df: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """V-01 to V-04, S-05: the k nearest rows after the filter, ties by key (TakeOrderedAndProject)."""
    d = df if where is None else df.where(where)
    return d.withColumn("distance", METRICS[metric](vector, query)).orderBy("distance", key).limit(k)


def centroids(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """V-09: the mean vector of each group."""
    parts = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def assign_nearest(df: DataFrame, centers: DataFrame, key: str, group: str, vector: str = "embedding") -> DataFrame:
    """V-09: each row's nearest centroid by L2; centroids are few (a row per group) and held in one array."""
    packed = centers.agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c"))).alias("cs"))
    best = F.array_min(F.transform("cs", lambda s: F.struct(l2(F.col(vector), s["c"]).alias("d"), s["g"].alias("g"))))
    return df.crossJoin(F.broadcast(packed)).select(key, best["g"].alias(group), best["d"].alias("distance"))


def reassign_noise(df: DataFrame, key: str, label: str, vector: str = "embedding", noise: int = -1) -> DataFrame:
    """V-09: rows of the noise label take the label of the nearest centroid of the others."""
    rest = df.where(F.col(label) != noise)
    moved = assign_nearest(df.where(F.col(label) == noise), centroids(rest, label, vector), key, label, vector).select(key, label)
    return rest.select(key, label).unionByName(moved)


def coherence(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """A-34: mean cosine over the pairs of each group, in closed form from the sum of unit vectors; alone is 1."""
    unit = df.withColumn("_n", F.sqrt(dot(vector, vector))).where("_n > 0")
    parts = unit.select(group, "_n", F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double") / F.col("_n")).alias("s"))
    length = parts.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = unit.groupBy(group).agg(F.count("*").alias("n"))
    mean = F.when(F.col("n") < 2, F.lit(1.0)).otherwise((F.col("q") - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)))
    return length.join(n, group).select(group, "n", mean.alias("coherence"))


Q0 = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


def _query(spark, d, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


@R.query("v_knn_cosine", "V-01 S-05", f"SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings, {Q0} ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 20")
def _(spark, d):
    return knn(table(spark, d, "embeddings"), _query(spark, d), 20).select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@R.query("v_knn_l2", "V-02", f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings, {Q0} ORDER BY list_distance(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 20")
def _(spark, d):
    return knn(table(spark, d, "embeddings"), _query(spark, d), 20, "l2").select("vec_id", F.round("distance", 6).alias("distance"))


@R.query("v_knn_ip_filtered", "V-03 V-04", f"SELECT vec_id, round(-list_inner_product(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings, {Q0} WHERE label IN (1, 2, 3) ORDER BY -list_inner_product(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 20")
def _(spark, d):
    return knn(table(spark, d, "embeddings"), _query(spark, d), 20, "ip", where=F.col("label").isin(1, 2, 3)).select("vec_id", F.round("distance", 6).alias("distance"))


CENT = "cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) t GROUP BY 1)"


@R.query("v_centroid_assign", "V-09", f"WITH {CENT} SELECT vec_id, arg_min(c.label, list_distance(CAST(embedding AS DOUBLE[]), c.c)) AS label FROM embeddings e, cent c GROUP BY vec_id")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return assign_nearest(e.drop("label"), centroids(e, "label"), "vec_id", "label").select("vec_id", "label")


@R.query("v_reassign_noise", "V-09", f"WITH e AS (SELECT *, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS l FROM embeddings), cent AS (SELECT l AS label, list(m ORDER BY i) AS c FROM (SELECT l, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM e, range(1, 65) r(i) WHERE l <> -1 GROUP BY 1, 2) t GROUP BY 1) SELECT vec_id, l AS label FROM e WHERE l <> -1 UNION ALL SELECT vec_id, arg_min(c.label, list_distance(CAST(embedding AS DOUBLE[]), c.c)) FROM e, cent c WHERE l = -1 GROUP BY vec_id")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("label", F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label")))
    return reassign_noise(e, "vec_id", "label")


COHERENCE_SQL = """WITH w AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM w),
p AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM u),
s AS (SELECT label, k, sum(x) AS x, count(*) AS n FROM p GROUP BY 1, 2)
SELECT label, CAST(round(CAST(CASE WHEN max(n) = 1 THEN 1 ELSE (sum(x * x) - max(n)) / (max(n) * (max(n) - 1)) END AS DECIMAL(38,12)), 5) AS DOUBLE) AS coherence
FROM s GROUP BY label"""


@R.query("v_coherence", "A-34", COHERENCE_SQL)
def _(spark, d):
    return coherence(table(spark, d, "embeddings"), "label").select("label", decimal("coherence", 5).alias("coherence"))


@R.query("v_adjacent", "V-08", "SELECT a.vec_id, CAST(round(CAST(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DECIMAL(38,12)), 6) AS DOUBLE) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = (SELECT max(vec_id) FROM embeddings c WHERE c.label = a.label AND c.vec_id < a.vec_id)")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("prev", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.where("prev is not null").select("vec_id", decimal(cosine("embedding", "prev"), 6).alias("s"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
