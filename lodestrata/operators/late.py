"""Late interaction: candidates of a search ranked anew by their token vectors.

A text's score for a question is the sum, over the question's tokens, of the largest cosine that any of the text's tokens has
with it. Token vectors of texts are packed in blocks of at most ``BLOCK_TOKENS``; candidates meet their blocks by text, each
block gives the largest cosine for each token of the question, and blocks are put together by a maximum before the sum. So
long texts are many rows, and only candidates' vectors are read into it.

Defined results: vectors without a place (see ``lists``) are no tokens; a candidate without tokens, or of a question without
any, scores 0; ties go by the search's score, then by text; the search's score stays as original_score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import ship, table
from .lists import _pack, _valid, build_lists
from .rewrites import decimal, top_per_group

R = Registry()
BLOCK_TOKENS = 512


def _packed(tokens: DataFrame, key: str, dim: int) -> DataFrame:
    """Rows (key, part, keys, vectors): unit vectors of (key, token, v), the token numbers beside them."""
    kind = tokens.schema[key].dataType.simpleString()
    t = tokens.select(F.struct(F.col(key).alias("k"), F.col("token").cast("long").alias("token")).alias("at"), "v")
    t = _valid(t, "at", "v", dim, "cosine").select(F.col("at.k").alias("k"), "at.token", "vector")
    t = t.withColumns({"list": F.xxhash64("k"), "part": F.expr(f"token div {BLOCK_TOKENS}")})
    packed = t.groupBy("k", "list", "part").applyInArrow(lambda g: _with_key(g, _pack("token", "vector")(g)), f"k {kind}, keys array<bigint>, vectors binary")
    return packed


def _with_key(group, packed):
    import pyarrow as pa

    return pa.table({"k": group["k"].slice(0, 1), "keys": packed["keys"], "vectors": packed["vectors"]})


def max_sim(candidates: DataFrame, questions: DataFrame, texts: DataFrame, dim: int, k: int | None = None) -> DataFrame:
    """R-08: (query, doc, original_score, similarity, rank) of candidates (query, doc, similarity), for token vectors (query, token, v)
    of questions and (doc, token, v) of texts; the k best of each question, if k is given."""
    ship(candidates.sparkSession)
    asked = _packed(questions, "query", dim).select(F.col("k").alias("query"), F.col("keys").alias("asked_tokens"), F.col("vectors").alias("asked"))
    held = _packed(texts.join(candidates.select("doc").distinct(), "doc", "left_semi"), "doc", dim).select(F.col("k").alias("doc"), "vectors")
    met = candidates.select("query", "doc").join(asked, "query").join(held, "doc").select("query", "doc", "asked_tokens", "asked", "vectors")
    kinds = [candidates.schema[c].dataType.simpleString() for c in ("query", "doc")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                q, x = (np.frombuffer(b.column(c)[i].as_py(), float).reshape(-1, dim) for c in (3, 4))
                n = len(q)
                best = (q @ x.T).max(1)
                yield pa.record_batch([b.column(0).take(pa.array([i] * n)), b.column(1).take(pa.array([i] * n)), b.column(2)[i].values, pa.array(best)], names=["query", "doc", "token", "best"])

    found = met.mapInArrow(run, f"query {kinds[0]}, doc {kinds[1]}, token long, best double")
    score = found.groupBy("query", "doc", "token").agg(F.max("best").alias("best")).groupBy("query", "doc").agg(F.sum("best").alias("score"))
    out = candidates.join(score, ["query", "doc"], "left").select("query", "doc", F.col("similarity").alias("original_score"), F.coalesce("score", F.lit(0.0)).alias("similarity"))
    order = [F.desc(F.round("similarity", 9)), F.desc("original_score"), F.asc("doc")]
    return top_per_group(out, ["query"], order, (1 << 31) - 1 if k is None else k).withColumnRenamed("rn", "rank")


LATE_SQL = """WITH t AS (SELECT vec_id // 4 AS doc, vec_id % 4 AS token, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT a.doc AS query, b.doc, list_cosine_similarity(a.v, b.v) AS s FROM t a JOIN t b ON a.token = 0 AND b.token = 0 AND a.doc <> b.doc WHERE a.doc % 10 = 0
    QUALIFY row_number() OVER (PARTITION BY a.doc ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.doc) <= 20),
best AS (SELECT n.query, n.doc, n.s, q.token, max(list_cosine_similarity(q.v, d.v)) AS m FROM near n JOIN t q ON q.doc = n.query JOIN t d ON d.doc = n.doc GROUP BY 1, 2, 3, 4)
SELECT query, doc, CAST(round(CAST(s AS DECIMAL(38,12)), 6) AS DOUBLE) AS original_score, CAST(round(CAST(sum(m) AS DECIMAL(38,12)), 6) AS DOUBLE) AS similarity FROM best GROUP BY 1, 2, s"""


@R.query("rt_late_interaction", "R-08", LATE_SQL)
def _(spark, d):
    """Vectors by fours as the tokens of a text: the twenty nearest by the first token of every tenth text, ranked anew by all."""
    t = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("doc"), F.expr("vec_id % 4").alias("token"), F.col("embedding").alias("v"))
    lead = t.where("token = 0").select("doc", "v")
    index = build_lists(lead, key="doc", vector="v")
    asked = t.where("doc % 10 = 0").withColumnRenamed("doc", "query")
    near = index.search_exact(asked.where("token = 0").select("query", F.col("v").alias("vector")), 20, others=True)
    near = near.select("query", F.col("neighbour").alias("doc"), (1 - F.col("distance")).alias("similarity"))
    return max_sim(near, asked, t, index.dim).select("query", "doc", decimal("original_score", 6).alias("original_score"), decimal("similarity", 6).alias("similarity"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
