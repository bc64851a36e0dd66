"""Table maintenance as set operations: upserts, merges, updates of nested fields, snapshots with history.

A table version is a directory; a manifest lists them. Nothing is updated in place, so a failed writer leaves the last
version as it was.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import table

R = Registry()


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """DML-01, DML-02: rows of source replace rows of target with the same key; the rest of both stays."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """DML-01: ON CONFLICT DO NOTHING; of source rows with one key, one is taken."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DML-03: idempotent landing: the latest row of each key."""
    from .rewrites import distinct_on

    return distinct_on(df, keys, order)


def upsert_with(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, object]) -> DataFrame:
    """DML-04, DML-07: full outer join; each other column by rule (new, old) -> Column, by default new over old."""
    cols = [c for c in target.columns if c not in keys]
    both = target.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_in_o")).join(source.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_in_n")), keys, "full")
    out = []
    for c in cols:
        new, old = F.col(f"_n_{c}"), F.col(f"_o_{c}")
        merged = rules[c](new, old) if c in rules else F.coalesce(new, old)
        out.append(F.when(F.col("_in_o").isNull(), new).when(F.col("_in_n").isNull(), old).otherwise(merged).alias(c))
    return both.select(*keys, *out)


def merge(target: DataFrame, source: DataFrame, keys: list[str], update_if: str | None = None, insert_if: str | None = None, delete_if: str | None = None) -> DataFrame:
    """DML-05, DML-06: MERGE as one full outer join; columns t.* and s.* in the conditions, action in the result.

    Matched rows that meet update_if take the source's values, new rows that meet insert_if are added, rows of target
    that source lacks and that meet delete_if get the action delete (drop them to apply). A null condition is false.
    """
    cols = [c for c in target.columns if c not in keys]
    t = target.select(F.struct("*").alias("t"), *[F.col(k).alias(f"_t{k}") for k in keys])
    s = source.select(F.struct("*").alias("s"), *[F.col(k).alias(f"_s{k}") for k in keys])
    on = None
    for k in keys:
        c = F.col(f"_t{k}") == F.col(f"_s{k}")
        on = c if on is None else on & c
    holds = lambda x: F.coalesce(F.expr(x), F.lit(False)) if x else F.lit(False)
    both = t.join(s, on, "full")
    action = F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), F.when(holds(update_if), "update").otherwise("keep")).when(F.col("t").isNull(), F.when(holds(insert_if), "insert").otherwise("skip")).otherwise(F.when(holds(delete_if), "delete").otherwise("keep"))
    both = both.withColumn("action", action).where("action <> 'skip'")
    new = F.col("action").isin("update", "insert")
    return both.select(*[F.coalesce(F.col(f"t.{k}"), F.col(f"s.{k}")).alias(k) for k in keys], *[F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in cols], "action")


def replace_by_key(docs: DataFrame, chunks: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """DML-09: documents of the sources and their chunks removed from both tables."""
    gone = docs.where(F.col("source").isin(sources)).select(F.col("id").alias("document_id"))
    return docs.where(~F.col("source").isin(sources)), chunks.join(gone, "document_id", "left_anti")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """ST-04, I-01: INSERT, UPDATE and DELETE between two snapshots, with old and new as JSON."""
    cols = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.to_json(F.struct(*cols)).alias("old"))
    n = new.select(*keys, F.to_json(F.struct(*cols)).alias("new"))
    both = o.join(n, keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("op", F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE"))


def update_fields(df: DataFrame, where: Column, set: dict | None = None, inc: dict | None = None, push: dict | None = None, pull: dict | None = None, add_to_set: dict | None = None, pop: list | None = None, unset: list | None = None, rename: dict | None = None) -> DataFrame:
    """DML-11: document updates of the rows that meet the condition; unset and rename change the schema."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    new = {}
    for ops, f in ((set, lambda c, v: lit(v)), (inc, lambda c, v: F.col(c) + lit(v)), (push, lambda c, v: F.array_append(c, lit(v))), (pull, lambda c, v: F.array_remove(c, v)), (add_to_set, lambda c, v: F.array_union(c, F.array(lit(v))))):
        for c, v in (ops or {}).items():
            new[c] = F.when(where, f(c, v)).otherwise(F.col(c)) if c in df.columns else F.when(where, lit(v))
    for c in pop or []:
        new[c] = F.when(where & (F.size(c) > 0), F.slice(c, 1, F.size(c) - 1)).otherwise(F.col(c))
    out = df.withColumns(new) if new else df
    return out.drop(*(unset or [])).withColumnsRenamed(rename or {})


def push_capped(c: Column, more: Column, n: int) -> Column:
    """DML-12: values pushed to an array of which the last n stay."""
    return F.slice(F.concat(c, more), -F.least(F.size(c) + F.size(more), F.lit(n)), n)


def buckets(df: DataFrame, key: str, order: list[str], size: int, value: str) -> DataFrame:
    """DML-12, ST-08: values in order, as arrays of at most size per (key, bucket)."""
    from pyspark.sql import Window

    r = df.withColumn("bucket", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return r.groupBy(key, "bucket").agg(F.count("*").alias("n"), F.transform(packed, lambda x: x["_v"]).alias("values"))


def find_and_modify(df: DataFrame, where: Column, order: list[Column], change: dict[str, Column] | None, key: str) -> tuple[DataFrame, DataFrame]:
    """DML-19: (table, affected): the first match in an order changed, or deleted if change is None."""
    first = df.where(where).orderBy(*order).limit(1)
    if change is None:
        return df.join(first.select(key), key, "left_anti"), first
    after = first.withColumns(change)
    return upsert(df, after, [key]), after


def update_returning(df: DataFrame, where: Column, changes: dict[str, Column], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """C-06: (table, changed rows) of an update of every row that meets the condition; the rows come with their new values."""
    changed = df.where(where).withColumns(changes).select(*df.columns)
    return upsert(df, changed, keys), changed


def bulk_write(df: DataFrame, operations: list, keys: list[str]) -> DataFrame:
    """DML-13: an ordered list of ('insert' | 'upsert' | 'delete' | 'update', argument)."""
    for op, x in operations:
        df = {"insert": lambda t, x: t.unionByName(x, allowMissingColumns=True), "upsert": lambda t, x: upsert(t, x, keys), "delete": lambda t, x: t.where(~F.coalesce(x, F.lit(False))), "update": lambda t, x: update_fields(t, **x)}[op](df, x)
    return df


class VersionedTable:
    """SRC-18, SRC-19, DML-08: snapshot directories with a history; commits retry on conflict.

    A version is written under a name of its own and becomes visible by a manifest file that must not exist yet, made
    through Spark's file system, so two writers cannot commit one version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, p: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def history(self) -> list[dict]:
        """Commits in order: version, time, operation, data directory."""
        fs, at = self._fs(f"{self.path}/_log")
        if not fs.exists(at):
            return []
        out = []
        for s in fs.listStatus(at):
            if s.getPath().getName().endswith(".json"):
                text = self.spark.read.text(s.getPath().toString(), wholetext=True).first()[0]
                out.append(json.loads(text))
        return sorted(out, key=lambda x: x["version"])

    def read(self, version: int | None = None) -> DataFrame:
        log = self.history()
        found = log[-1:] if version is None else [x for x in log if x["version"] == version]
        if not found:
            raise ValueError(f"no version {version} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{found[0]['data']}")

    def _commit(self, version: int, entry: dict) -> bool:
        fs, at = self._fs(f"{self.path}/_log/{version:010d}.json")
        try:
            out = fs.create(at, False)
        except Exception:
            return False
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def write(self, make, operation: str = "WRITE", retries: int = 5, wait: float = 0.05) -> int:
        """Commit make(current or None); made again from the newest version when another writer came first."""
        for k in range(retries):
            log = self.history()
            version = log[-1]["version"] + 1 if log else 0
            data = f"v={version}-{uuid.uuid4().hex[:8]}"
            df = make(self.read() if log else None) if callable(make) else make
            df.write.parquet(f"{self.path}/{data}")
            if self._commit(version, {"version": version, "time": time.time(), "operation": operation, "data": data}):
                return version
            time.sleep(wait * 2**k)
        raise RuntimeError("commit conflict")


@R.query("dml_upsert", "DML-01 DML-02 J-06", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer UNION ALL SELECT c_custkey + 1000000, 'ADDED' FROM customer WHERE c_custkey % 10 = 0")
def _(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    s = t.where("c_custkey % 3 = 0").withColumn("seg", F.lit("NEW")).unionByName(t.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("ADDED").alias("seg")))
    return upsert(t, s, ["c_custkey"])


@R.query("dml_insert_missing", "DML-01", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return insert_missing(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@R.query("dml_keep_latest", "DML-03", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1")
def _(spark, d):
    return keep_latest(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@R.query("dml_upsert_rules", "DML-04 DML-07", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.conf WHEN b.k IS NULL THEN a.conf ELSE greatest(a.conf, b.conf) END AS conf, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 1 ELSE 2 END AS n FROM (SELECT c_nationkey AS k, max(c_acctbal) AS conf FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS conf FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("conf")).withColumn("n", F.lit(1))
    b = table(spark, d, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("conf")).withColumn("n", F.lit(1))
    return upsert_with(a, b, ["k"], {"conf": lambda n, o: F.greatest(n, o), "n": lambda n, o: o + 1})


@R.query("dml_merge", "DML-05 DML-06", "SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN s.v WHEN s.k IS NOT NULL AND s.v <> t.v THEN s.v ELSE t.v END AS v, CASE WHEN t.k IS NULL THEN 'insert' WHEN s.k IS NULL THEN CASE WHEN t.v = 'BUILDING' THEN 'delete' ELSE 'keep' END WHEN s.v <> t.v THEN 'update' ELSE 'keep' END AS action FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) t FULL JOIN (SELECT c_custkey + 20 AS k, c_mktsegment AS v FROM customer) s ON t.k = s.k")
def _(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return merge(t, t.withColumn("k", F.col("k") + 20), ["k"], "s.v <> t.v", "true", "t.v = 'BUILDING'")


@R.query("dml_snapshot_diff", "ST-04 I-01 DML-05", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'INSERT' WHEN b.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    new = o.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("v")))
    return diff(o.where("k % 7 <> 0"), new, ["k"]).select("k", "op")


@R.query("dml_replace_cascade", "DML-09 DML-10", "SELECT 'docs' AS t, count(*) AS n FROM documents WHERE source NOT IN ('src1','src2') UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1','src2'))")
def _(spark, d):
    docs, ch = replace_by_key(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), table(spark, d, "labels").withColumnRenamed("doc_id", "document_id"), ["src1", "src2"])
    return docs.agg(F.count("*").alias("n")).select(F.lit("docs").alias("t"), "n").unionByName(ch.agg(F.count("*").alias("n")).select(F.lit("labels").alias("t"), "n"))


@R.query("dml_update_fields", "DML-11", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'BIG' ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS size, CASE WHEN p_size > 25 THEN concat(p_brand, '|new') ELSE p_brand END AS tags FROM part")
def _(spark, d):
    p = table(spark, d, "part").withColumn("tags", F.array("p_brand"))
    out = update_fields(p, F.col("p_size") > 25, set={"p_name": "BIG"}, inc={"p_size": 100}, push={"tags": "new"}, unset=["p_type"], rename={"p_size": "size"})
    return out.select("p_partkey", "p_name", "size", F.array_join("tags", "|").alias("tags"))


@R.query("dml_buckets", "DML-12", "SELECT user_id, CAST(bucket AS BIGINT) AS bucket, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM (SELECT *, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 5) AS bucket FROM events) t GROUP BY 1, 2")
def _(spark, d):
    return buckets(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5, "event_id").select("user_id", "bucket", "n", F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


@R.query("dml_find_and_delete", "DML-19", "SELECT p_partkey FROM part WHERE p_partkey <> (SELECT p_partkey FROM part WHERE p_size < 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 1)")
def _(spark, d):
    return find_and_modify(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), F.col("p_size") < 10, [F.desc("p_retailprice"), F.asc("p_partkey")], None, "p_partkey")[0].select("p_partkey")


@R.query("dml_bulk_write", "DML-13", "SELECT r_regionkey AS k, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS v FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 9, 'NINE'")
def _(spark, d):
    t = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    row = lambda k, v: t.sparkSession.range(1).select(F.lit(k).alias("k"), F.lit(v).alias("v"))
    return bulk_write(t, [("insert", row(9, "NINE")), ("upsert", row(1, "ONE")), ("delete", F.col("k") == 2)], ["k"])


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
