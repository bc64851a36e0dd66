"""Queries that write tables in the form a source has, read them by the source's reader, and run streams over them.

Each writes below the shared scratch folder; the SQL beside it asks the plain tables for the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import VersionedTable, update_returning
from ..plans.registry import Registry, run_sql
from ..session import scratch, table
from ..streaming.changes import CHANGE, change_stream, follow, merge_stream
from . import readers

R = Registry()
DAY = "date_format(o_orderdate, 'yyyy-MM-dd') AS day"


def _fs(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _put(spark, path: str, text: str) -> None:
    """One small file."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


# files -------------------------------------------------------------------------------------------------------------


@R.query("src_parquet_glob", "SRC-02", """
SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders
WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def _(spark, d):
    at = scratch(spark, "glob")
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    o.write.partitionBy("y", "o_orderstatus").parquet(at)
    got = readers.parquet_glob(spark, at, "*/o_orderstatus=[!P]/*.parquet")
    return got.groupBy(F.col("y").cast("long").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@R.query("src_attach", "SRC-03", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _(spark, d):
    readers.register_directory(spark, d, "attached_")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM attached_orders JOIN attached_customer ON c_custkey = o_custkey GROUP BY 1")


@R.query("src_csv_named", "SRC-04 SRC-14", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def _(spark, d):
    at = scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(at)
    return readers.csv_named(spark, at, "id long, name string, segment string")


@R.query("src_csv_years", "SRC-05", "SELECT year(o_orderdate) AS year, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(spark, d):
    at = scratch(spark, "years")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    o.repartition("y").write.partitionBy("y").csv(f"{at}/by")
    fs, base = _fs(spark, f"{at}/by")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{at}/named"))
    for s in fs.listStatus(base):  # a folder a year
        y = s.getPath().getName()[2:]
        for k, f in enumerate(fs.listStatus(s.getPath()) if s.isDirectory() else []):
            fs.rename(f.getPath(), path(f"{at}/named/yob{y}-{k}.txt"))
    got = readers.csv_with_year(spark, f"{at}/named", "key long, customer long")
    return got.groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@R.query("src_tsv_typed", "SRC-06 SRC-07 SRC-08", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders")
def _(spark, d):
    at = scratch(spark, "tsv")
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", DAY, "o_orderstatus")
    o.write.option("sep", "\t").option("header", True).csv(at)
    got = readers.csv_named(spark, at, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string", "\t", True)
    return got.selectExpr("o_orderkey", DAY, "o_orderstatus")


@R.query("src_sniff", "SRC-09", "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, '|' AS sep FROM supplier")
def _(spark, d):
    at = scratch(spark, "sniff")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("sep", "|").option("header", True).csv(at)
    kind = readers.sniff(spark, at)
    return readers.csv_named(spark, at, "id long, name string, nation int", kind["sep"], kind["header"]).select("id", "name", F.lit(kind["sep"]).alias("sep"))


@R.query("src_meetings", "SRC-11", """
SELECT CAST(n_nationkey AS STRING) AS meeting_id, n_name AS title, r_name AS owner, 'visit ' || n_name AS text, 2 AS people, 1 AS moments
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def _(spark, d):
    at = scratch(spark, "meetings")
    n = run_sql(spark, d, "SELECT CAST(n_nationkey AS STRING) AS meetingId, n_name, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
    one = lambda df, name: df.write.option("maxRecordsPerFile", 1).json(f"{at}/all/{name}.json")
    one(n.select("meetingId", F.col("n_name").alias("title"), F.array("r", "n_name", "r").alias("allEmails")), "meeting-info")
    one(n.select("meetingId", F.lit("Protect").alias("summary"), F.array(F.concat("r", F.lit(": visit "), "n_name")).alias("actionItems"), F.array(F.struct(F.lit(1.0).alias("time"), F.col("r").alias("text"))).alias("keyMoments")), "summary")
    t = readers.meeting_star(spark, at)
    count = lambda name, c: t[name].groupBy("meeting_id").agg(F.count("*").cast("int").alias(c))
    got = t["meetings"].select("meeting_id", "title").join(t["action_items"], "meeting_id").join(count("participants", "people"), "meeting_id").join(count("key_moments", "moments"), "meeting_id")
    return got.select("meeting_id", "title", "owner", "text", "people", "moments")


def _annotated(spark, d) -> str:
    """Nations as annotated documents, a file each: one answer to a possible and one to an impossible question."""
    at = scratch(spark, "annotated")
    q = """named_struct('question', concat('the "', {0}, '" of'), 'is_impossible', {1}, 'answers', array(named_struct('text', n_name, 'answer_start', n_nationkey)))"""
    run_sql(spark, d, f"""SELECT '1' AS version, array(named_struct('title', n_name, 'paragraphs', array(named_struct('context', n_name,
        'qas', array({q.format("'Governing Law'", "false")}, {q.format("'Parties'", "n_nationkey % 2 = 0")}))))) AS data
        FROM nation""").write.option("maxRecordsPerFile", 1).json(at)
    return at


@R.query("src_annotated", "SRC-12 I-08", """
SELECT n_name AS title, q AS question, n_name AS text, n_nationkey AS start FROM nation, (VALUES ('Governing Law'), ('Parties')) t(q)
WHERE q = 'Governing Law' OR n_nationkey % 2 = 1""")
def _(spark, d):
    return readers.squad_answers(spark, _annotated(spark, d))


@R.query("md_annotations", "I-09 SRC-12", """
SELECT n_name AS name, label, CAST(n_nationkey AS STRING) AS document_id, label AS edge_label
FROM nation, (VALUES ('Jurisdiction'), ('Party')) t(label) WHERE label = 'Jurisdiction' OR n_nationkey % 2 = 1""")
def _(spark, d):
    from ..operators.medallion import annotations_to_graph

    docs = run_sql(spark, d, "SELECT n_name AS title, CAST(n_nationkey AS STRING) AS document_id FROM nation")
    v, e = annotations_to_graph(readers.squad_answers(spark, _annotated(spark, d)), docs)
    e = e.join(v.select(F.col("uuid").alias("src"), F.col("label").alias("edge_label")), "src").select("src", "edge_label")
    return v.join(e, v["uuid"] == e["src"]).select("name", "label", "document_id", "edge_label")


@R.query("src_discover", "SRC-13", """
SELECT r_name || '.' || kind AS name, kind, CAST(length(r_name) AS BIGINT) AS length FROM (SELECT *, CASE WHEN r_regionkey % 2 = 0 THEN 'md' ELSE 'pdf' END AS kind FROM region) t""")
def _(spark, d):
    at = scratch(spark, "files")
    for k, name in run_sql(spark, d, "SELECT r_regionkey, r_name FROM region").collect():  # the regions, a few rows
        _put(spark, f"{at}/a{k}/b/{name}.{'md' if k % 2 == 0 else 'pdf'}", name)
        _put(spark, f"{at}/a{k}/{name}.unknown", name)
    return readers.discover(spark, at).select(F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1).alias("name"), "kind", "length")


@R.query("src_export", "SRC-15 SRC-17", """
SELECT 'csv' AS form, p_partkey, p_name, p_size FROM part UNION ALL SELECT 'json', p_partkey, p_name, p_size FROM part""")
def _(spark, d):
    at = scratch(spark, "export")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    readers.export_csv(p, f"{at}/csv")
    readers.export_json(p, f"{at}/json")
    names = "p_partkey long, p_name string, p_size int"
    got = readers.csv_named(spark, f"{at}/csv", names, header=True).select(F.lit("csv").alias("form"), "*")
    return got.unionByName(spark.read.schema(names).json(f"{at}/json").select(F.lit("json").alias("form"), "*"))


@R.query("src_batches", "SRC-16", "SELECT CAST(floor(n_nationkey / 10) AS BIGINT) AS batch, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "nation").orderBy("n_nationkey")
    return spark.createDataFrame([(k, len(b), max(r["n_name"] for r in b)) for k, b in enumerate(readers.batches(n, 10))], "batch long, n long, last string")


@R.query("src_cast", "SRC-20", "SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS day, CAST(NULL AS STRING) AS note FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string"), F.col("value").cast("string"), F.col("ts").cast("string"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("ts", T.TimestampType()), T.StructField("note", T.StringType())])
    return readers.cast_stream(e, schema).select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), "note")


@R.query("src_columns", "SRC-22", """
SELECT table_name AS tab, column_name AS name, CASE lower(data_type) WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' ELSE lower(data_type) END AS type
FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'part', 'nation')""")
def _(spark, d):
    out = []
    for t in ("orders", "customer", "part", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"listed_{t}")
        out += [(t, name, "timestamp" if kind.startswith("timestamp") else kind) for name, kind, _ in readers.describe_table(spark, f"listed_{t}")]
    return spark.createDataFrame(out, "tab string, name string, type string")


# versions, views, changes ------------------------------------------------------------------------------------------


@R.query("dml_versions", "SRC-18 SRC-19 DML-08", """
SELECT 0 AS version, 'OVERWRITE' AS operation, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part
UNION ALL SELECT 1, 'UPDATE', count(*), CAST(sum(CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END) AS BIGINT) FROM part
UNION ALL SELECT 2, 'DELETE', count(*), CAST(sum(CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END) AS BIGINT) FROM part WHERE p_brand <> 'Brand#13'""")
def _(spark, d):
    t = VersionedTable(spark, scratch(spark, "versions"))
    t.write(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "OVERWRITE")
    t.write(lambda old: old.withColumn("p_size", F.when(F.col("p_size") > 25, F.col("p_size") + 1).otherwise(F.col("p_size"))), "UPDATE")
    t.write(lambda old: old.where("p_brand <> 'Brand#13'"), "DELETE")
    out = None
    for h in t.history():  # three versions
        v = t.read(h["version"]).agg(F.count("*").alias("n"), F.sum("p_size").alias("size")).select(F.lit(h["version"]).alias("version"), F.lit(h["operation"]).alias("operation"), "n", "size")
        out = v if out is None else out.unionByName(v)
    return out


@R.query("dml_view", "DML-16", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def _(spark, d):
    run_sql(spark, d, "CREATE OR REPLACE TEMPORARY VIEW solvent AS SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM solvent GROUP BY 1")


@R.query("dml_update_returning", "C-06", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new, changed = update_returning(o, F.col("o_orderstatus") == "P", {"o_totalprice": F.col("o_totalprice") * 2}, ["o_orderkey"])
    return new.join(changed.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@R.query("cte_written", "C-04", """
WITH big AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT a.o_custkey FROM big a WHERE a.total > (SELECT 1.5 * avg(total) FROM big)""")
def _(spark, d):
    at = scratch(spark, "cte")  # computed once, read by both uses
    run_sql(spark, d, "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1").write.parquet(at)
    spark.read.parquet(at).createOrReplaceTempView("big_written")
    return spark.sql("SELECT a.o_custkey FROM big_written a WHERE a.total > (SELECT 1.5 * avg(total) FROM big_written)")


JOINS = {
    "hash": ("BroadcastHashJoin", "SELECT /*+ BROADCAST(nation) */ count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "merge": ("SortMergeJoin", "SELECT /*+ MERGE(orders) */ count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey"),
    "nested loop": ("BroadcastNestedLoopJoin", "SELECT /*+ BROADCAST(nation) */ count(*) AS n FROM supplier LEFT JOIN nation ON n_nationkey > s_nationkey"),
}


@R.query("j_kinds", "J-28", """
SELECT 'hash' AS kind, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'merge', count(*) FROM customer JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT 'nested loop', count(*) FROM supplier LEFT JOIN nation ON n_nationkey > s_nationkey""")
def _(spark, d):
    out = None
    for kind, (node, text) in JOINS.items():
        df = run_sql(spark, d, text)
        if node not in df._jdf.queryExecution().executedPlan().toString():
            raise RuntimeError(f"no {node} in the plan")
        out = df.select(F.lit(kind).alias("kind"), "n") if out is None else out.unionByName(df.select(F.lit(kind).alias("kind"), "n"))
    return out


# streams -----------------------------------------------------------------------------------------------------------


def _changes(spark, d, where: str = "true"):
    return run_sql(spark, d, f"SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op, user_id AS key, props AS doc FROM events WHERE {where}")


def _keep(at: str):
    """A handler that writes each micro-batch below a folder of its number, so that a repeated one replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/batch={number}")


@R.query("st_change_stream", "ST-01 ST-03", "SELECT event_id AS id, user_id AS key, props AS doc FROM events WHERE event_type <> 'error'")
def _(spark, d):
    at = scratch(spark, "changes")
    _changes(spark, d).write.json(f"{at}/in")
    follow(change_stream(spark, f"{at}/in", ["update"], files_per_batch=2), _keep(f"{at}/out"), f"{at}/token")
    return spark.read.schema(CHANGE).parquet(f"{at}/out").select("id", "key", "doc")


@R.query("st_resume", "ST-02", """
SELECT CASE WHEN value < 100 THEN 'first' ELSE 'resumed' END AS run, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1""")
def _(spark, d):
    at = scratch(spark, "resume")
    for run, where in (("first", "value < 100"), ("resumed", "NOT value < 100 OR value IS NULL")):
        _changes(spark, d, where).write.mode("append").json(f"{at}/in")
        follow(change_stream(spark, f"{at}/in"), _keep(f"{at}/{run}"), f"{at}/token")
    got = [spark.read.schema(CHANGE).parquet(f"{at}/{run}").select(F.lit(run).alias("run"), "id") for run in ("first", "resumed")]
    return got[0].unionByName(got[1]).groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@R.query("st_merge_stream", "ST-06", """
SELECT user_id AS key, props AS doc FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) t
WHERE r = 1 AND event_type <> 'error'""")
def _(spark, d):
    at = scratch(spark, "merged")
    target = VersionedTable(spark, f"{at}/table")
    cut = run_sql(spark, d, "SELECT coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id), 0) FROM events").first()[0]
    for where in (f"event_id < {cut}", f"event_id >= {cut}"):  # changes arrive in order of id
        _changes(spark, d, where).write.mode("append").json(f"{at}/in")
        merge_stream(change_stream(spark, f"{at}/in", files_per_batch=1000), target, ["key"], f"{at}/token")
    return target.read().select("key", "doc")


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
