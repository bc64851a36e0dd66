"""Relational queries in SQL: filters, joins, aggregation, windows, sets, common table expressions.

Covers the course challenges (CH), the joined-query suite and the window, subquery and set families over the driver's
tables. Stand-ins: ``names`` counts orders by year, priority and status; ``gdp`` sums order totals by nation and year.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ordered import GlobalOrder
from ..operators.rewrites import decimal
from ..session import table
from .registry import Registry

R = Registry()
NAMES = "names AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, o_orderpriority AS name, o_orderstatus AS sex, count(*) AS cnt FROM orders GROUP BY 1, 2, 3)"
GDP = "gdp AS (SELECT n_name AS country, CAST(year(o_orderdate) AS INT) AS yr, sum(CAST(o_totalprice AS DECIMAL(38,4))) AS usd FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def dec(x: str, n: int = 2) -> str:
    """A double rounded as a decimal, alike in both engines."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {n}) AS DOUBLE)"


# challenges
R.sql("ch01_top_filter", "PF-01 CH01", f"WITH {NAMES} SELECT name, sex, cnt FROM names WHERE yr = 1996 ORDER BY cnt DESC, name, sex LIMIT 10")
R.sql("ch02_share_pct", "PF-02 C-01 CH02", f"WITH {NAMES} SELECT name, sum(cnt) AS total, {dec('100.0 * sum(cnt) / (SELECT sum(cnt) FROM names)', 4)} AS share_pct FROM names GROUP BY name".replace("sum(cnt) AS total", "CAST(sum(cnt) AS BIGINT) AS total"))
R.sql("ch03_like_between", "PF-03 CH03", "SELECT p_partkey, p_name, p_size FROM part WHERE p_brand LIKE 'Brand#1%' AND p_size BETWEEN 10 AND 20 AND p_size IN (10, 12, 14, 16, 18, 20)")
R.sql("ch04_distinct_not_in", "A-06 J-10 CH04", "SELECT n_name, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P') GROUP BY n_name")
R.sql("ch05_yearly", "A-01 CH05", f"SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n, {dec('sum(o_totalprice)')} AS total, {dec('avg(o_totalprice)')} AS mean, {dec('max(o_totalprice)')} AS top FROM orders GROUP BY 1")
R.sql("ch06_having_distinct", "A-02 CH06", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 4")
R.sql("ch07_conditional_sum", "A-03 CH07", f"WITH {NAMES} SELECT yr, CAST(sum(CASE WHEN sex = 'F' THEN cnt ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN sex = 'O' THEN cnt ELSE 0 END) AS BIGINT) AS o, {dec('100.0 * sum(CASE WHEN sex = ' + chr(39) + 'F' + chr(39) + ' THEN cnt ELSE 0 END) / sum(cnt)')} AS f_pct FROM names GROUP BY yr")
R.sql("ch08_above_average", "C-01 CH08", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_mktsegment = 'BUILDING'")
R.sql("ch09_first_per_year", "C-02 W-02 CH09", f"WITH {NAMES}, r AS (SELECT *, rank() OVER (PARTITION BY yr, sex ORDER BY cnt DESC) AS rk FROM names) SELECT yr, sex, name, cnt FROM r WHERE rk = 1")
R.sql("ch10_not_exists", "J-09 S-04 CH10", "WITH a AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(38,4))) AS s FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1 ORDER BY s DESC, k LIMIT 50), b AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(38,4))) AS s FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1 ORDER BY s DESC, k LIMIT 50) SELECT a.k FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k)")
R.sql("ch11_self_join", "J-07 CH11", f"WITH {NAMES} SELECT a.name, a.sex, a.cnt AS c95, b.cnt AS c96, b.cnt - a.cnt AS diff FROM names a JOIN names b ON a.name = b.name AND a.sex = b.sex WHERE a.yr = 1995 AND b.yr = 1996")
R.sql("ch12_join_agg", "J-01 CH12", f"SELECT n_name, count(*) AS n, {dec('avg(c_acctbal)')} AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
R.sql("ch13_unmatched", "J-06 CH13", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
R.sql("ch14_top3_per_group", "W-01 CH14", "SELECT yr, o_orderkey, o_totalprice FROM (SELECT CAST(year(o_orderdate) AS INT) AS yr, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
R.sql("ch15_rank_dense", "W-02 CH15", "SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS dr FROM customer")
R.sql("ch16_lag_lead", "W-04 CH16", f"WITH {GDP} SELECT country, yr, {dec('usd')} AS usd, {dec('usd - lag(usd) OVER (PARTITION BY country ORDER BY yr)')} AS change, {dec('lead(usd) OVER (PARTITION BY country ORDER BY yr)')} AS next FROM gdp")
R.sql("ch17_running_total", "W-05 CH17", f"WITH {NAMES} SELECT yr, name, sex, CAST(sum(cnt) OVER (PARTITION BY name ORDER BY yr) AS BIGINT) AS running FROM names")


@R.query("ch18_ntile", "W-03 CH18", f"SELECT q, count(*) AS n, {dec('min(c_acctbal)')} AS lo, {dec('max(c_acctbal)')} AS hi FROM (SELECT c_acctbal, CAST(ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer) t GROUP BY q")
def _(spark, d):
    c = GlobalOrder(table(spark, d, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"]).tiles(4, "q")
    return c.groupBy("q").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).withColumns({k: decimal(k) for k in ("lo", "hi")})


R.sql("ch19_growth", "W-18 C-02 CH19", f"WITH {GDP}, y AS (SELECT country, yr, CAST(usd AS DOUBLE) AS usd, lag(CAST(usd AS DOUBLE)) OVER (PARTITION BY country ORDER BY yr) AS prev FROM gdp), top AS (SELECT country FROM gdp GROUP BY country ORDER BY sum(usd) DESC, country LIMIT 5) SELECT country, {dec('avg((usd - prev) / prev * 100)', 3)} AS growth FROM y WHERE prev > 0 AND country IN (SELECT country FROM top) GROUP BY country")
R.sql("ch20_stable", "A-10 CH20", f"WITH {NAMES} SELECT name, sex, count(*) AS yrs, {dec('stddev_samp(cnt)', 4)} AS sd FROM names GROUP BY name, sex HAVING count(*) = (SELECT count(DISTINCT yr) FROM names)")
# predicates and projections
R.sql("pf_ilike_or", "PF-04", "SELECT p_partkey FROM part WHERE p_type ILIKE '%brass%' OR p_name ILIKE '%green%' OR p_type ILIKE 'promo%'")
R.sql("pf_masks", "PF-05", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT (o_totalprice < 150000) AND o_orderpriority <> '1-URGENT'")
R.sql("pf_case_buckets", "PF-13 A-15", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM orders GROUP BY 1")
R.sql("pf_coalesce_nullif", "PF-14 PF-16", f"SELECT s_suppkey, coalesce(nullif(s_nationkey, 0), -1) AS nk, {dec('s_acctbal / nullif(s_nationkey, 0)', 4)} AS ratio FROM supplier")
R.sql("pf_fill_clip", "PF-15", "SELECT c_custkey, CAST(greatest(0, least(c_acctbal, 5000)) AS DOUBLE) AS clipped, coalesce(c_mktsegment, 'none') AS seg FROM customer")
R.sql("pf_range_pruned", "PF-18", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_quantity < 24".replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_quantity < 24")
# joins
R.sql("j_star5", "J-02 S-01", f"SELECT r_name, n_name, count(*) AS n, {dec('sum(l_extendedprice * (1 - l_discount))')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name ORDER BY r_name DESC, n_name")
R.sql("j_using", "J-03", "SELECT k, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1) x JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) y USING (k) GROUP BY k")
R.sql("j_on_filter", "J-04", "SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
R.sql("j_left_total", "J-05", f"SELECT c_custkey, {dec('coalesce(sum(o_totalprice), 0)')} AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
R.sql("j_cooccurrence", "J-08", "SELECT a.l_returnflag AS fa, b.l_returnflag AS fb, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1, 2")
R.sql("j_two_memberships", "J-11", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
R.sql("j_full_outer", "J-12", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
R.sql("j_lateral_top", "J-13", "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation CROSS JOIN LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) t")


@R.query("j_lateral_latest", "J-14", "SELECT c_custkey, t.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) t ON true")
def _(spark, d):
    """The latest order of each customer. In Spark's own LATERAL the LIMIT takes any row if it orders by a column that the
    subquery does not return."""
    latest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(latest.alias("o_orderkey"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


R.sql("j_cross_one_row", "J-16", "SELECT count(*) AS n FROM part CROSS JOIN (SELECT avg(p_retailprice) AS m FROM part) q WHERE p_retailprice > q.m")
R.sql("j_merge_multi", "J-17", "SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) c ON s_nationkey = c_nationkey")
R.sql("j_fan_out", "J-26", "SELECT c_nationkey, count(o_orderkey) AS o, count(s_suppkey) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 8000 GROUP BY c_nationkey")
R.sql("j_cross_source", "J-27", "SELECT d.source, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
# aggregation
R.sql("a_filter_pivot", "A-04 A-05", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0")
R.sql("a_mixed_distinct", "A-06 A-07", f"SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders_n, {dec('1.0 * count(*) / nullif(count(DISTINCT l_orderkey), 0)', 4)} AS per_order FROM lineitem GROUP BY l_suppkey")
R.sql("a_pct_of_total", "A-08", f"SELECT o_orderpriority, count(*) AS n, {dec('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM orders GROUP BY o_orderpriority")
R.sql("a_mode", "A-09", "SELECT c_nationkey, mode() WITHIN GROUP (ORDER BY c_mktsegment) AS m FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, c_mktsegment AS m FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rn FROM customer GROUP BY 1, 2) t WHERE rn = 1")
R.sql("a_min_max_avg", "A-11", f"SELECT event_type, {dec('min(value)', 4)} AS lo, {dec('max(value)', 4)} AS hi, {dec('avg(value)', 4)} AS mean FROM events GROUP BY event_type")
R.sql("a_distinct", "A-12", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
R.sql("a_two_level", "A-16", f"SELECT CASE WHEN n <= 5 THEN 'few' WHEN n <= 15 THEN 'some' ELSE 'many' END AS band, count(*) AS customers, {dec('avg(total)')} AS mean FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) t GROUP BY 1")
R.sql("a_value_counts", "A-22", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, CAST(sum(CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM customer GROUP BY c_mktsegment")
R.sql("a_argmax", "A-25", "SELECT c_nationkey, max_by(c_custkey, c_acctbal) AS best FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS best FROM customer GROUP BY c_nationkey")
R.sql("a_median", "A-26 A-27", f"SELECT l_returnflag, {dec('percentile(l_extendedprice, 0.5)', 4)} AS med, {dec('percentile(l_extendedprice, 0.95)', 4)} AS p95 FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {dec('quantile_cont(l_extendedprice, 0.5)', 4)} AS med, {dec('quantile_cont(l_extendedprice, 0.95)', 4)} AS p95 FROM lineitem GROUP BY l_returnflag")
R.sql("a_weighted_sum", "A-32", f"SELECT l_linestatus, {dec('sum(l_quantity * l_extendedprice)')} AS w FROM lineitem GROUP BY l_linestatus")
R.sql("a_q1", "A-01", f"SELECT l_returnflag, l_linestatus, {dec('sum(l_quantity)')} AS qty, {dec('sum(l_extendedprice)')} AS base, {dec('sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))')} AS charge, {dec('avg(l_discount)', 6)} AS disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
# windows
R.sql("w_rows_frame", "W-06 W-07", f"SELECT event_id, {dec('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS running, {dec('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 4)} AS trailing, {dec('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 4)} AS centred FROM events")
R.sql("w_range_peers", "W-08", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM orders")
R.sql("w_first_last", "W-10", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


@R.query("w_percent_rank", "W-11", f"SELECT c_custkey, {dec('percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal)', 6)} AS pr, {dec('percent_rank() OVER (ORDER BY c_acctbal)', 6)} AS pr_all FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    c = c.withColumn("pr", F.percent_rank().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal")))
    c = GlobalOrder(c, ["c_acctbal", "c_custkey"], keys=1).ranked(percent="pr_all")
    return c.select("c_custkey", decimal("pr", 6).alias("pr"), decimal("pr_all", 6).alias("pr_all"))


R.sql("w_named", "W-12", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER w AS BIGINT) AS rn, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
R.sql("w_multi_partition", "W-13 W-14", f"SELECT o_orderkey, {dec('o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus, o_orderpriority)', 8)} AS share, {dec('o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus, o_orderpriority)', 4)} AS delta FROM orders")
R.sql("w_group_rank", "W-16", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS BIGINT) AS rk FROM lineitem")
R.sql("w_pct_change", "W-17", f"SELECT user_id, event_id, {dec('value / nullif(lag(value) OVER w, 0) - 1', 4)} AS change, {dec('sum(value) OVER w', 4)} AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")


@R.query("w_relevance_rank", "W-20", "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rn FROM documents WHERE lang = 'en'")
def _(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars")
    return GlobalOrder(docs, ["-n_chars", "doc_id"]).numbered("rn").select("doc_id", "rn")


# sorting, sets, common table expressions
R.sql("s_nulls_last", "S-02", "SELECT c_custkey, t.last_key FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_key FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) t ON o_custkey = c_custkey ORDER BY t.last_key ASC NULLS LAST, c_custkey")
R.sql("s_paging", "S-03", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
R.sql("set_union_all", "SET-01 SET-02 DML-18", "SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
R.sql("set_intersect", "SET-03", "SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996")
R.sql("set_except", "SET-04", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995")
R.sql("c_scalar_max", "C-01", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
R.sql("c_cte_having", "C-03 C-07", f"WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1 HAVING count(*) > 10) SELECT c_custkey, {dec('s')} AS s FROM customer JOIN big ON o_custkey = c_custkey")
R.sql("c_recursive_tree", "C-05 S-06", "WITH RECURSIVE edge AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation), tree AS (SELECT id, name, 0 AS depth, name AS path FROM edge WHERE parent IS NULL UNION ALL SELECT e.id, e.name, t.depth + 1, concat(t.path, '/', e.name) FROM edge e JOIN tree t ON e.parent = t.id) SELECT id, depth, path FROM tree")
# joined-query suite over a sales star: orders as sales, customer and region as dimensions
R.sql("ns_revenue_by_tier", "J-01 J-02", f"SELECT c_mktsegment AS tier, r_name AS region_name, {dec('sum(o_totalprice)')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
R.sql("ns_above_average_customers", "C-01 C-02", f"WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_custkey, {dec('s')} AS s FROM t WHERE s > (SELECT avg(s) FROM t)")
R.sql("ns_rank_in_region", "W-02", f"WITH t AS (SELECT n_regionkey, c_custkey, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY s DESC) AS rk FROM t) SELECT n_regionkey, c_custkey, {dec('s')} AS s FROM r WHERE rk = 1")

QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
