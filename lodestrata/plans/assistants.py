"""Queries over what stands around a model: the guarded SQL session, caches, rewriting, contexts, memories, extraction.

Models are scripted, so that the rows are known; the SQL beside each asks the plain tables for them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..operators import fusion, graph, ingest, medallion
from ..operators.rewrites import decimal, pii_violations
from ..providers import CachedEmbedder, HashEmbedder, PatternExtractor
from ..session import load_tables, scratch, table
from .registry import Registry, run_sql
from .session_sql import Conversation, check_read_only, run_with_timeout, strip_fences

R = Registry()


class Scripted:
    """A generator that gives its answers in turn and keeps what it was asked."""

    def __init__(self, *answers: str):
        self.answers, self.prompts = list(answers), []

    def generate(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.answers[min(len(self.prompts), len(self.answers)) - 1]


def _values(rows: list[tuple], names: str) -> str:
    """SQL of constant rows."""
    lit = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


# the SQL session ---------------------------------------------------------------------------------------------------

STATEMENTS = [
    ("SELECT 1", True),
    ("WITH a AS (SELECT 1 AS x) SELECT x FROM a", True),
    ("SELECT 'drop' AS word", False),
    ("INSERT INTO part SELECT * FROM part", False),
    ("FROM part INSERT OVERWRITE TABLE part SELECT *", False),
    ("DROP TABLE part", False),
    ("SHOW TABLES", False),
    ("SELECT 1; DELETE FROM part", False),
]


@R.query("ns_guard", "N-01", _values(STATEMENTS, "statement, allowed"))
def _(spark, d):
    def allowed(sql: str) -> bool:
        try:
            check_read_only(spark, sql)
        except PermissionError:
            return False
        return True

    return spark.createDataFrame([(s, allowed(s)) for s, _ in STATEMENTS], "statement string, allowed boolean")


@R.query("ns_timeout", "N-03", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    df = run_sql(spark, d, "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
    return spark.createDataFrame(run_with_timeout(spark, df, 300.0), df.schema)  # a row a nation


@R.query("ns_corrected", "N-04 N-06 N-10", "SELECT p_brand AS brand, count(*) AS n, 2 AS attempts FROM part GROUP BY 1")
def _(spark, d):
    load_tables(spark, d)
    g = Scripted("```sql\nSELECT p_brnd, count(*) FROM part GROUP BY 1;\n```", "```sql\nSELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand;\n```")
    got = Conversation(spark, g, timeout=300.0).ask("parts by brand")
    return got.to_dataframe(spark, "brand string, n long").withColumn("attempts", F.lit(got.attempts))


@R.query("ns_caches", "N-05 N-08", _values([("By Segment", False, 1, 0), ("by  segment", True, 0, 0), ("segments, please", True, 1, 1), ("orders", False, 1, 2), ("orders again", True, 1, 3), ("all orders", True, 1, 3)], "question, cached, attempts, turns"))
def _(spark, d):
    load_tables(spark, d)
    a, b = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", "SELECT count(*) AS n FROM orders"
    g = Scripted(a, a, b, b, b)
    c = Conversation(spark, g, timeout=300.0)
    out = []
    for q in ("By Segment", "by  segment", "segments, please", "orders", "orders again", "all orders"):
        before = len(g.prompts)
        r = c.ask(q)
        out.append((q, r.cached, r.attempts, g.prompts[-1].count("\nSQL: ") if len(g.prompts) > before else 0))
    return spark.createDataFrame(out, "question string, cached boolean, attempts int, turns int")


@R.query("ns_fences", "N-04", _values([(0, "SELECT 1"), (1, "SELECT 1"), (2, "SELECT 'x'")], "k, sql"))
def _(spark, d):
    texts = ["SELECT 1;", "Here:\n```sql\nSELECT 1;\n```\nDone.", "```\nSELECT 'x'\n```"]
    return spark.createDataFrame([(k, strip_fences(t)) for k, t in enumerate(texts)], "k int, sql string")


PROTECTED = [("SELECT c_name FROM customer", 1), ("SELECT count(c_name) FROM customer", 0), ("SELECT upper(c.c_name), c_phone FROM customer c", 2), ("SELECT c_mktsegment, max(c_phone) FROM customer GROUP BY 1", 0)]


@R.query("ns_protected", "PF-19", _values(PROTECTED, "statement, n"))
def _(spark, d):
    return spark.createDataFrame([(s, len(pii_violations(s, ["c_name", "c_phone"]))) for s, _ in PROTECTED], "statement string, n int")


# retrieval ---------------------------------------------------------------------------------------------------------


@R.query("rt_cache", "R-06", "SELECT 'cached' AS state, 1 AS size, 1 AS hits, 1 AS misses UNION ALL SELECT 'cleared', 0, 1, 2")
def _(spark, d):
    chunks = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit(0).alias("document_id"), F.col("text").alias("content"))
    r = fusion.Retriever(chunks)
    rows = r.retrieve("which river", 3, "fuzzy"), r.retrieve("Which River ", 3, "fuzzy")
    if rows[0] != rows[1]:
        raise RuntimeError("a cached answer differs")
    out = [("cached", *r.cache.stats().values())]
    r.cache.clear()  # as ingestion does
    r.cache.get(r.cache.key("which river", 3, "fuzzy"))
    out.append(("cleared", *r.cache.stats().values()))
    return spark.createDataFrame(out, "state string, size int, hits int, misses int")


@R.query("rt_context", "R-07", """
SELECT string_agg(concat('--- Source [', CAST(k AS STRING), '] ', c_name, ' (relevance: 0.', CAST(95 - 5 * k AS STRING), ')', chr(10), c_mktsegment), chr(10) || chr(10) ORDER BY k) AS context
FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) t WHERE k <= 5""")
def _(spark, d):
    top = run_sql(spark, d, "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS content FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
    rows = [r.asDict() | {"similarity": 0.9 - 0.05 * k} for k, r in enumerate(top.collect())]  # five rows
    return spark.createDataFrame([(fusion.format_context(rows),)], "context string")


REWRITTEN = [("none", 1, "late shipments"), ("lines", 1, "late shipments"), ("lines", 2, "delayed orders"), ("lines", 3, "overdue deliveries")]


@R.query("rt_rewrites", "R-09", _values(REWRITTEN, "generator, k, query"))
def _(spark, d):
    g = Scripted("1. delayed orders\n2. late shipments\n- overdue deliveries\n4. slow freight")
    out = [(name, k, q) for name, x in (("none", None), ("lines", g)) for k, q in enumerate(fusion.expand_queries("late shipments", x, 3), 1)]
    return spark.createDataFrame(out, "generator string, k int, query string")


@R.query("rt_graph_text", "R-13", """
WITH ent AS (SELECT c_name AS name, c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_name) AS rank FROM customer),
rel AS (SELECT e.name, e.rank AS er, o_orderpriority AS rel_type, CAST(o_orderkey AS STRING) AS dst FROM orders JOIN ent e ON e.c_custkey = o_custkey WHERE e.rank <= 5),
num AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rel_type, dst) AS rn FROM rel),
txt AS (SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS line, row_number() OVER (ORDER BY p_retailprice DESC, p_name || ' ' || CAST(p_partkey AS STRING)) AS rank FROM part)
SELECT 'entity' AS part, CAST(rank AS BIGINT) AS rank, name AS line FROM ent WHERE rank <= 10
UNION ALL SELECT 'relation', CAST(er * 10 + rn AS BIGINT), name || ' ' || rel_type || ' ' || dst FROM num WHERE rn <= 5
UNION ALL SELECT 'text', CAST(rank AS BIGINT), line FROM txt WHERE rank <= 20""")
def _(spark, d):
    e = run_sql(spark, d, "SELECT c_name AS name, c_acctbal AS score FROM customer")
    r = run_sql(spark, d, "SELECT c_name AS src, o_orderpriority AS rel_type, CAST(o_orderkey AS STRING) AS dst FROM orders JOIN customer ON c_custkey = o_custkey")
    t = run_sql(spark, d, "SELECT concat(p_name, ' ', p_partkey) AS line, p_retailprice AS score FROM part")
    return fusion.fuse_graph_and_text(e, r, t).withColumn("rank", F.col("rank").cast("long"))


MEMORIES = [("all", "likes green tea"), ("all", "works in Oslo"), ("found", "works in Oslo"), ("history", "ADD"), ("history", "DELETE"), ("after", "works in Oslo")]


@R.query("rt_memories", "R-14", _values(MEMORIES, "step, text"))
def _(spark, d):
    m = fusion.MemoryStore(spark)
    tea, _ = m.add("ann", "likes green tea"), m.add("ann", "works in Oslo")
    m.add("bob", "works in Rome")
    out = [("all", t) for _, t in m.get_all("ann")] + [("found", t) for _, t, _ in m.search("ann", "who works in Oslo", 1)]
    m.delete("ann", tea)
    out += [("history", op) for op in m.history("ann", tea)] + [("after", t) for _, t in m.get_all("ann")]
    return spark.createDataFrame(out, "step string, text string")


@R.query("v_cached_embedder", "V-07", _values([(1, 0, 2), (2, 1, 3), (3, 2, 4)], "ask, hits, misses"))
def _(spark, d):
    e, out = CachedEmbedder(HashEmbedder(16), size=2), []
    for k, texts in enumerate((["a b", "c"], ["c", "d"], ["a b", "d"]), 1):  # "a b" is the one that went
        if e.embed(texts) != HashEmbedder(16).embed(texts):
            raise RuntimeError("a cached vector differs")
        out.append((k, e.hits, e.misses))
    return spark.createDataFrame(out, "ask int, hits int, misses int")


# documents to chunks, tables and graphs ----------------------------------------------------------------------------


@R.query("in_headings", "I-03", """
SELECT p_partkey, 0 AS chunk_index, p_brand AS path, p_name AS content FROM part UNION ALL SELECT p_partkey, 1, p_brand || ' > Type', p_type FROM part
UNION ALL SELECT p_partkey, 2, 'Size', CAST(p_size AS STRING) FROM part""")
def _(spark, d):
    p = run_sql(spark, d, "SELECT p_partkey, concat('# ', p_brand, '\\n', p_name, '\\n## Type\\n\\n', p_type, '\\n# Empty\\n# Size\\n', p_size) AS text FROM part")
    return ingest.by_arrow(p, "p_partkey", "text", ingest.heading_chunks, "chunk_index int, path string, content string")


@R.query("in_table_text", "I-26", """
SELECT s_suppkey, k, v FROM (SELECT s_suppkey, 'name' AS k, s_name AS v FROM supplier
UNION ALL SELECT s_suppkey, 'note', CAST(s_nationkey AS STRING) FROM supplier) t""")
def _(spark, d):
    from ..functions.scalars import table_records

    s = run_sql(spark, d, "SELECT s_suppkey, concat('| name | note | nation |\\n|---|---|---|\\n| ', s_name, ' |  | ', s_nationkey, ' |') AS text FROM supplier")
    return ingest.by_arrow(s, "s_suppkey", "text", lambda t: [kv for r in table_records(t) for kv in r.items()], "k string, v string")


def _extracted(spark, d):
    """Bronze rows of one sentence a customer, as the pattern extractor reads them."""
    c = run_sql(spark, d, """SELECT CAST(c_nationkey AS STRING) AS contract_id, CAST(c_custkey AS INT) AS chunk_index, concat('Acme', substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2)),
        ' Inc is under the laws of Utah. ', CASE WHEN c_custkey % 3 = 0 THEN 'It may terminate at will.' ELSE '' END) AS text FROM customer""")
    return medallion.extract(c, PatternExtractor())


@R.query("md_extract", "I-10", """
SELECT CAST(c_nationkey AS STRING) AS contract_id, CAST(c_custkey AS INT) AS chunk_index, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS entities, 1 AS relationships, 'GOVERNED_BY' AS rel_type FROM customer""")
def _(spark, d):
    return _extracted(spark, d).select("contract_id", "chunk_index", F.size("entities").alias("entities"), F.size("relationships").alias("relationships"), F.col("relationships")[0]["rel_type"].alias("rel_type"))


@R.query("md_report", "E-09", """
WITH n AS (SELECT count(*) AS c, count(*) FILTER (WHERE c_custkey % 3 = 0) AS t, count(DISTINCT c_nationkey) AS k FROM customer)
SELECT 'total' AS part, 'contracts' AS name, CAST(k AS DOUBLE) AS value FROM n UNION ALL SELECT 'total', 'chunks', c FROM n UNION ALL SELECT 'total', 'entities', 2 * c + t FROM n
UNION ALL SELECT 'total', 'relationships', c FROM n UNION ALL SELECT 'total', 'mean_confidence', 0.9 FROM n
UNION ALL SELECT 'total', 'entities_per_chunk', round((2 * c + t) / c, 6) FROM n UNION ALL SELECT 'total', 'relationships_per_chunk', 1 FROM n
UNION ALL SELECT 'label', 'Party', c FROM n UNION ALL SELECT 'label', 'Jurisdiction', c FROM n UNION ALL SELECT 'label', 'TerminationClause', t FROM n
UNION ALL SELECT 'rel_type', 'GOVERNED_BY', c FROM n""")
def _(spark, d):
    at = scratch(spark, "bronze")
    _extracted(spark, d).write.parquet(at)
    return medallion.extraction_report(spark.read.parquet(at)).withColumn("value", decimal("value", 6))


@R.query("gs_cypher_text", "GS-11", """
SELECT s_suppkey, k, line FROM (SELECT s_suppkey, 0 AS k, 'MERGE (n:Party {id: ''' || s_name || '''}) SET n.name = ''' || s_name || '''' AS line FROM supplier
UNION ALL SELECT s_suppkey, 1, 'MERGE (n:Jurisdiction {id: ''' || n_name || '''}) SET n.name = ''' || n_name || '''' FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT s_suppkey, 2, 'MATCH (a {id: ''' || s_name || '''}), (b {id: ''' || n_name || '''}) MERGE (a)-[:GOVERNED_BY]->(b)' FROM supplier JOIN nation ON n_nationkey = s_nationkey) t""")
def _(spark, d):
    def lines(text: str) -> list[tuple[int, str]]:
        x = json.loads(text)
        nodes = [{"label": "Party", "id": x["p"]}, {"label": "Jurisdiction", "id": x["j"]}]
        return list(enumerate(graph.cypher_of(nodes, [{"src": x["p"], "dst": x["j"], "rel_type": "GOVERNED_BY"}])))

    s = run_sql(spark, d, "SELECT s_suppkey, to_json(named_struct('p', s_name, 'j', n_name)) AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey")
    return ingest.by_arrow(s, "s_suppkey", "text", lines, "k int, line string")


@R.query("gs_valid_at", "GS-12", """
SELECT o_custkey AS src, o_orderkey AS dst FROM orders
WHERE o_orderdate <= TIMESTAMP '1995-06-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 100 DAY > TIMESTAMP '1995-06-01')""")
def _(spark, d):
    e = run_sql(spark, d, "SELECT o_custkey AS src, o_orderkey AS dst, o_orderdate AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 100 DAY END AS valid_to FROM orders")
    return graph.valid_at(e, F.lit(pd.Timestamp("1995-06-01").to_pydatetime())).select("src", "dst")


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
