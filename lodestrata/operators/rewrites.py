"""Relational operators that Spark has no syntax for, as compositions of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import scratch, table

R = Registry()


def decimal(c: Column | str, n: int = 2) -> Column:
    """Rounding of a double as a decimal, alike in all engines."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("decimal(38,12)"), n).cast("double")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A-13: the first row of each key in the given order (DISTINCT ON)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """W-01, J-13, J-19: at most n rows of each key; the rank stays as rn (WindowGroupLimit prunes before the shuffle)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def groups_frame(df: DataFrame, value: str, part: list[str], order: str, before: int, name: str) -> DataFrame:
    """W-09: sum over a GROUPS frame, as a RANGE frame over the dense rank of the order column."""
    w = Window.partitionBy(*part)
    ranked = df.withColumn("_g", F.dense_rank().over(w.orderBy(order)))
    return ranked.withColumn(name, F.sum(value).over(w.orderBy("_g").rangeBetween(-before, 0))).drop("_g")


def rolling(df: DataFrame, value: str, part: list[str], order: list[str], n: int, name: str, min_periods: int | None = None, how=F.avg) -> DataFrame:
    """W-15: rolling aggregate of the last n rows, null until min_periods (n, if unset) values are there."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) >= (n if min_periods is None else min_periods), how(value).over(w)))


def not_equal(c: Column, v) -> Column:
    """PF-07: document-store $ne, which also matches missing fields."""
    return (c != v) | c.isNull()


def not_in(c: Column, values: list) -> Column:
    """PF-07: document-store $nin, which also matches missing fields."""
    return ~c.isin(values) | c.isNull()


def has_all(c: Column, values: list) -> Column:
    """PF-09: $all."""
    return F.size(F.array_except(F.array(*map(F.lit, values)), c)) == 0


def slice_rows(df: DataFrame, order: list[Column], rows: int, columns: int) -> DataFrame:
    """PF-06: the first rows and columns by position, in an explicit order."""
    return df.orderBy(*order).limit(rows).select(*df.columns[:columns])


def lookup(left: DataFrame, right: DataFrame, local: str, foreign: str, name: str, fields: list[str], order: list[Column] | None = None, n: int | None = None, where: Column | None = None) -> DataFrame:
    """J-18, J-19: left outer join into an array of structs, optionally of the first n matches in an order."""
    r = right if where is None else right.where(where)
    if n is not None:
        r = top_per_group(r, [foreign], order, n)
        packed = F.transform(F.array_sort(F.collect_list(F.struct("rn", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    else:
        packed = F.array_sort(F.collect_list(F.struct(*fields)))
    own = r.groupBy(F.col(foreign).alias("_k")).agg(packed.alias(name))
    out = left.join(own, left[local] == own["_k"], "left").drop("_k")
    empty = F.array().cast(own.schema[name].dataType)
    return out.withColumn(name, F.coalesce(name, empty))


def graph_lookup(start: DataFrame, edges: DataFrame, start_key: str, from_col: str, to_col: str, max_depth: int, where: Column | None = None) -> DataFrame:
    """J-21: (start, node, depth) of all nodes reached breadth first, the least depth of each; edges may be restricted.

    One join per level on the frontier. Each level is written to the shared folder, so that the plan of one does not
    hold those before it; the search ends where a level is empty.
    """
    spark = start.sparkSession
    e = (edges if where is None else edges.where(where)).select(F.col(from_col).alias("_from"), F.col(to_col).alias("_to"))
    front = start.select(F.col(start_key).alias("start"), F.col(start_key).alias("node"))
    at, seen = scratch(spark, "lookup"), []
    for depth in range(max_depth + 1):
        front = front.join(e, front["node"] == e["_from"]).select("start", F.col("_to").alias("node")).where(F.col("node").isNotNull()).distinct()
        if seen:
            front = front.join(spark.read.parquet(*seen).select("start", "node"), ["start", "node"], "left_anti")
        path = f"{at}/{depth}"
        front.withColumn("depth", F.lit(depth)).write.parquet(path)
        seen.append(path)
        front = spark.read.parquet(path).select("start", "node")
        if front.isEmpty():
            break
    return spark.read.parquet(*seen)


def bucket(c: Column, bounds: list, default: str) -> Column:
    """A-18: the lower bound of the half-open interval that c falls in, as text, or the default."""
    out = None
    for lo, hi in zip(bounds, bounds[1:]):
        hit = (c >= lo) & (c < hi)
        out = F.when(hit, F.lit(str(lo))) if out is None else out.when(hit, F.lit(str(lo)))
    return out.otherwise(F.lit(default))


def facet(df: DataFrame, **pipelines) -> dict[str, DataFrame]:
    """A-19: several pipelines over one input, as a dict of DataFrames."""
    return {k: f(df) for k, f in pipelines.items()}


def ordered_unique(df: DataFrame, value: str, position: str) -> DataFrame:
    """SET-05: values once, at their first position."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-22: count, nulls, distinct values, mean, deviation, least and largest of each column, one row each."""
    one = df.agg(*[f.alias(f"{c}__{n}") for c in columns for n, f in (("n", F.count(c)), ("nulls", F.count_if(F.col(c).isNull())), ("kinds", F.countDistinct(c)), ("mean", F.avg(c)), ("sd", F.stddev_samp(c)), ("lo", F.min(c)), ("hi", F.max(c)))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), *[F.col(f"{c}__{n}").cast("double").alias(n) for n in ("n", "nulls", "kinds", "mean", "sd", "lo", "hi")]) for c in columns])).alias("r")).select("r.*")


def pii_violations(sql: str, columns: list[str], allowed=("count", "max", "min", "sum", "approx_distinct", "approx_count_distinct")) -> list[str]:
    """PF-19: protected columns that a statement uses outside the allowed aggregates; a star outside of count names them all."""
    import re

    tokens = re.findall(r"'(?:[^']|'')*'|[A-Za-z_][\w.]*|\S", sql)
    stack, bad = [], []
    for k, t in enumerate(tokens):
        before = tokens[k - 1].lower() if k else ""
        if t == "(":
            stack.append(before)
        elif t == ")":
            stack and stack.pop()
        elif t == "*" and (before in ("select", "distinct", "all", ",") or before.endswith(".")):
            bad += sorted(columns)
        elif t.rpartition(".")[2].lower() in {c.lower() for c in columns} and not any(f in allowed for f in stack):
            bad.append(t)
    return bad


def exposed_columns(spark, sql: str, columns: list[str]) -> list[str]:
    """PF-19: protected columns that the result of a statement shows as they are, under any name and through any view,
    alias, star or subquery: what its analyzed plan's output is made of, down to the tables. Aggregates show no value but
    of the functions that keep one (min, max, first, any_value), which the guard allows."""
    plan = spark._jsparkSession.sql(sql).queryExecution().analyzed()
    made: dict[int, set[int]] = {}
    names: dict[int, str] = {}

    def each(seq):
        return [seq.apply(k) for k in range(seq.size())]

    def walk(p):
        for child in each(p.children()):
            walk(child)
        if p.nodeName() in ("Project", "Aggregate"):
            for e in each(p.projectList() if p.nodeName() == "Project" else p.aggregateExpressions()):
                refs = {a.exprId().id() for a in each(e.references().toSeq())}
                own = e.exprId().id()
                if own not in refs:
                    aggregate = p.nodeName() == "Aggregate" and own not in {a.exprId().id() for g in each(p.groupingExpressions()) for a in each(g.references().toSeq())} and "(" in e.toString()
                    made[own] = set() if aggregate else refs
        elif p.nodeName() == "Union":
            for k, a in enumerate(each(p.output())):
                made[a.exprId().id()] = made.get(a.exprId().id(), set()) | {each(c.output())[k].exprId().id() for c in each(p.children())} - {a.exprId().id()}
        elif not p.children().size():
            for a in each(p.output()):
                names[a.exprId().id()] = a.name()

    walk(plan)
    seen, todo = set(), [a.exprId().id() for a in each(plan.output())]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += made.get(x, ())
    wanted = {c.lower() for c in columns}
    return sorted({names[x] for x in seen if x in names and names[x].lower() in wanted})


@R.query("rw_distinct_on", "A-13", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _(spark, d):
    return distinct_on(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@R.query("rw_groups_frame", "W-09", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return groups_frame(o, "o_orderkey", ["o_orderstatus"], "day", 1, "s").select("o_orderkey", "s")


@R.query("rw_rolling_min_periods", "W-15", "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN CAST(round(CAST(avg(value) OVER w AS DECIMAL(38,12)), 4) AS DOUBLE) END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    e = rolling(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 3, "mean")
    return e.select("event_id", decimal("mean", 4).alias("mean"))


@R.query("rw_missing_safe", "PF-07", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE (seg <> 'MACHINERY' OR seg IS NULL) AND (seg NOT IN ('HOUSEHOLD') OR seg IS NULL)")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return c.where(not_equal(F.col("seg"), "MACHINERY") & not_in(F.col("seg"), ["HOUSEHOLD"])).select("c_custkey")


@R.query("rw_exists_regex", "PF-08", "SELECT p_partkey FROM part WHERE p_name IS NOT NULL AND regexp_matches(p_type, '(?i)^standard')")
def _(spark, d):
    return table(spark, d, "part").where(F.col("p_name").isNotNull() & F.col("p_type").rlike("(?i)^standard")).select("p_partkey")


@R.query("rw_array_all_elem", "PF-09 PF-17", "SELECT o_custkey FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, list(o_totalprice) AS t FROM orders GROUP BY 1) x WHERE list_contains(p, '1-URGENT') AND list_contains(p, '5-LOW') AND len(list_filter(t, lambda v: v > 100000 AND v < 200000)) > 0 AND len(p) > 0")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_list("o_totalprice").alias("t"))
    return g.where(has_all(F.col("p"), ["1-URGENT", "5-LOW"]) & F.exists("t", lambda v: (v > 100000) & (v < 200000)) & (F.size("p") > 0)).select("o_custkey")


@R.query("rw_project_replace_root", "PF-10 PF-11 PF-12", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS k2 FROM events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("meta", F.from_json("props", "k long"))
    return e.select("event_id", "meta.*").withColumns({"k2": F.col("k") * 2})


@R.query("rw_iloc", "PF-06 S-04", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def _(spark, d):
    return slice_rows(table(spark, d, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 15, 3)


@R.query("rw_lookup", "J-18 J-20", "SELECT c_custkey, len(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey".replace("len(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL))", "count(o_orderkey)"))
def _(spark, d):
    out = lookup(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey", "orders", ["o_orderkey"], where=F.col("o_orderstatus") == "P")
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@R.query("rw_lookup_pipeline", "J-19", "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn), '') AS keys FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey AND rn <= 5 GROUP BY c_custkey")
def _(spark, d):
    out = lookup(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey", "top", ["o_orderkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, F.col("o_orderstatus") == "F")
    return out.select("c_custkey", F.array_join(F.transform("top", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@R.query("rw_unwind_outer", "J-20", "SELECT user_id, v FROM (SELECT user_id, unnest(CASE WHEN count(*) FILTER (WHERE value > 90) = 0 THEN [NULL] ELSE list(event_id) FILTER (WHERE value > 90) END) AS v FROM events GROUP BY user_id) t")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("value") > 90, F.col("event_id"))).alias("ids"))
    return g.select("user_id", F.explode_outer("ids").alias("v"))


@R.query("rw_graph_lookup", "J-21", "WITH RECURSIVE e AS (SELECT CAST(p_partkey AS BIGINT) AS a, CAST(floor(p_partkey / 3) AS BIGINT) AS b FROM part WHERE p_partkey >= 3), w AS (SELECT a AS start, b AS node, 0 AS depth FROM e UNION ALL SELECT w.start, e.b, w.depth + 1 FROM w JOIN e ON w.node = e.a WHERE w.depth < 2) SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "part").where("p_partkey >= 3").select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 3).alias("b"))
    return graph_lookup(e, e, "a", "a", "b", 2)


@R.query("rw_bucket", "A-18", "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN '0' WHEN p_size >= 10 AND p_size < 25 THEN '10' WHEN p_size >= 25 AND p_size < 40 THEN '25' ELSE 'other' END AS b, count(*) AS n, CAST(round(CAST(avg(p_retailprice) AS DECIMAL(38,12)), 2) AS DOUBLE) AS mean FROM part GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").groupBy(bucket(F.col("p_size"), [0, 10, 25, 40], "other").alias("b")).agg(F.count("*").alias("n"), decimal(F.avg("p_retailprice")).alias("mean"))


@R.query("rw_facet", "A-19 A-20", "SELECT 'brand' AS facet, p_brand AS k, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM part")
def _(spark, d):
    f = facet(
        table(spark, d, "part"),
        brand=lambda x: x.groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("n")),
        size=lambda x: x.groupBy(F.col("p_size").cast("string").alias("k")).agg(F.count("*").alias("n")),
        all=lambda x: x.agg(F.count("*").alias("n")).select(F.lit("all").alias("k"), "n"),
    )
    out = None
    for name, df in f.items():
        one = df.select(F.lit(name).alias("facet"), "k", "n")
        out = one if out is None else out.unionByName(one)
    return out


@R.query("rw_group_accumulators", "A-17", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_orderkey) AS hi, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS pushed, count(DISTINCT o_orderstatus) AS kinds, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_orderkey").alias("s"), F.max("o_orderkey").alias("hi"), F.array_sort(F.collect_list("o_orderkey")).alias("p"), F.size(F.collect_set("o_orderstatus")).cast("long").alias("kinds"), F.min("o_orderkey").alias("first_key"))
    return g.select("o_custkey", "s", "hi", F.array_join(F.col("p").cast("array<string>"), ",").alias("pushed"), "kinds", "first_key")


@R.query("rw_bson_size", "A-21", "SELECT r_regionkey, length(concat('{\"r_regionkey\":', CAST(r_regionkey AS VARCHAR), ',\"r_name\":\"', r_name, '\"}')) AS size FROM region")
def _(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return r.select("r_regionkey", F.length(F.to_json(F.struct("*"))).cast("long").alias("size"))


@R.query("rw_pivot", "A-24 A-23", "SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS decade, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("decade", F.floor(F.year("o_orderdate") / 10) * 10)
    return o.groupBy("decade").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("decade", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@R.query("rw_ordered_unique", "SET-05", "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return ordered_unique(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@R.query("rw_json_agg", "A-29", "SELECT n_regionkey, string_agg(concat('{\"k\":', CAST(n_nationkey AS VARCHAR), ',\"n\":\"', n_name, '\"}'), ',' ORDER BY n_nationkey) AS js FROM nation GROUP BY 1".replace("string_agg(", "concat('[', string_agg(").replace(" ORDER BY n_nationkey) AS js", " ORDER BY n_nationkey), ']') AS js"))
def _(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))))).alias("js"))


@R.query("rw_distribution", "A-30 A-31 GP-08", "SELECT label, count(*) AS n, CAST(round(CAST(1 - count(DISTINCT vec_id % 50) * 1.0 / count(*) AS DECIMAL(38,12)), 6) AS DOUBLE) AS dedup_rate FROM embeddings GROUP BY label")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), decimal(1 - F.countDistinct(F.col("vec_id") % 50) / F.count("*"), 6).alias("dedup_rate"))


@R.query("rw_approx_distinct", "A-33")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@R.query("rw_describe", "A-22", "SELECT 'o_totalprice' AS name, CAST(count(o_totalprice) AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS nulls, CAST(count(DISTINCT o_totalprice) AS DOUBLE) AS kinds, CAST(round(CAST(avg(o_totalprice) AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean, CAST(round(CAST(stddev_samp(o_totalprice) AS DECIMAL(38,12)), 4) AS DOUBLE) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def _(spark, d):
    return describe(table(spark, d, "orders"), ["o_totalprice"]).withColumn("mean", decimal("mean", 4)).withColumn("sd", decimal("sd", 4))


@R.query("rw_melt", "SRC-10", "SELECT n_nationkey, name, CAST(v AS BIGINT) AS v FROM (SELECT n_nationkey, 'customers' AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS v FROM nation UNION ALL SELECT n_nationkey, 'suppliers', (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation) t")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    wide = n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0)
    return wide.unpivot(["n_nationkey"], ["customers", "suppliers"], "name", "v")


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
