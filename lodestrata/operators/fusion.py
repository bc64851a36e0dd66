"""Rank fusion and retrieval: arms as ranked DataFrames, fused in one plan; caches and providers stay on the driver."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..providers import HashEmbedder, OverlapReranker
from ..session import table
from . import search, vectors
from .ordered import GlobalOrder, exact_percentiles
from .rewrites import decimal, top_per_group

R = Registry()


def ranked(df: DataFrame, score: str, key: str, base: int = 0, n: int | None = None) -> DataFrame:
    """(key, rank): by falling score, ties by key; the first n by a top-k before the window, so one task ranks n rows; all
    rows by range partitions."""
    d = df.select(key, score)
    if n is None:
        rows = GlobalOrder(d.withColumn("_score", -F.col(score)), ["_score", key]).numbered("_row")
        return rows.select(key, (F.col("_row") - 1 + base).alias("rank"))
    d = d.orderBy(F.desc(score), F.asc(key)).limit(n)
    return d.select(key, (F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))) - 1 + base).alias("rank"))


def rrf(arms: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """R-01 to R-04: (key, score, first_arm) of ranked arms; the score is the sum of 1 / (k + rank) in the arms' own rank
    base; ties go by the first arm and its rank."""
    every = None
    for n, a in enumerate(arms):
        one = a.select(key, "rank", F.lit(n).alias("arm"))
        every = one if every is None else every.unionByName(one)
    g = every.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("f"))
    return g.select(key, "score", F.col("f.arm").alias("first_arm"), F.col("f.rank").alias("first_rank"))


def fused_top(arms: list[DataFrame], key: str, n: int, k: int = 60) -> DataFrame:
    return rrf(arms, key, k).orderBy(F.desc("score"), F.asc("first_arm"), F.asc("first_rank")).limit(n)


def embed_column(df: DataFrame, text: str, embedder, name: str = "embedding", batch: int = 100) -> DataFrame:
    """V-06: embeddings by Arrow batches of at most so many texts a call."""

    def run(t: pd.Series) -> pd.Series:
        xs = t.fillna("").tolist()
        return pd.Series([v for k in range(0, len(xs), batch) for v in embedder.embed(xs[k : k + batch])])

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(text))


def rerank(df: DataFrame, query: str, text: str = "content", reranker=None) -> DataFrame:
    """R-08: similarity replaced by the reranker's score; the old one stays as original_score."""
    model = reranker or OverlapReranker()

    def run(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(query, t.fillna("").tolist()))

    return df.withColumn("original_score", F.col("similarity")).withColumn("similarity", F.pandas_udf(run, "double")(text))


class ResultCache:
    """R-06: least recently used, at most so many entries, each for so many seconds."""

    def __init__(self, size: int = 100, ttl: float = 300.0, clock=time.monotonic):
        self.size, self.ttl, self.clock, self.rows = size, ttl, clock, OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(query: str, k: int, kind: str) -> str:
        return hashlib.sha256(f"{query.strip().lower()}|{k}|{kind}".encode()).hexdigest()[:24]

    def get(self, key: str):
        hit = self.rows.get(key)
        if hit is None or self.clock() - hit[0] > self.ttl:
            self.rows.pop(key, None)
            self.misses += 1
            return None
        self.rows.move_to_end(key)
        self.hits += 1
        return hit[1]

    def set(self, key: str, value) -> None:
        self.rows[key] = (self.clock(), value)
        self.rows.move_to_end(key)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)

    def clear(self) -> None:
        self.rows.clear()

    def stats(self) -> dict:
        return {"size": len(self.rows), "hits": self.hits, "misses": self.misses}


@dataclass
class Retriever:
    """R-05: over chunks (id, document_id, content, embedding, title, source): cache, over-fetch, arms, fusion, rerank,
    similarity floor (semantic only), cache."""

    chunks: DataFrame
    embedder: object = field(default_factory=HashEmbedder)
    reranker: object | None = None
    cache: ResultCache = field(default_factory=ResultCache)
    floor: float = 0.4
    over_fetch: int = 3
    most: int = 50
    rewrite: object | None = None

    def arm(self, kind: str, query: str, n: int) -> DataFrame:
        """One ranking: (id, score), at most n rows."""
        c = self.chunks
        if kind == "semantic":
            v = self.embedder.embed([query])[0]
            return c.select("id", vectors.cosine("embedding", v).alias("score")).orderBy(F.desc("score"), "id").limit(n)
        if kind == "text":
            s = search.rank_tf(c, query, id_col="id", text_col="content").join(search.match_all(c, query, id_col="id", text_col="content"), "id", "left_semi")
        elif kind == "bm25":
            s = search.bm25(c, query, id_col="id", text_col="content")
        elif kind == "fuzzy":
            s = c.select("id", search.trigram_similarity(F.col("content"), F.lit(query)).alias("score")).where("score > 0.2")
        else:
            raise ValueError(f"unknown search type {kind!r}")
        return s.orderBy(F.desc("score"), "id").limit(n)

    def search(self, query: str, k: int = 5, kind: str = "hybrid") -> DataFrame:
        """(id, similarity, ...) in falling order; a failing arm gives no rows."""
        n = min(self.most, k * self.over_fetch) if self.reranker else k
        if kind == "hybrid":
            none = self.chunks.select("id", F.lit(0.0).alias("score"))
            arms = [ranked(search.or_empty(lambda a=a: self.arm(a, query, 2 * n), none), "score", "id") for a in ("semantic", "text", "fuzzy", "bm25")]
            top = fused_top(arms, "id", n).select("id", F.col("score").alias("similarity"))
        else:
            top = self.arm(kind, query, n).withColumnRenamed("score", "similarity")
        return self.chunks.drop("embedding").join(F.broadcast(top), "id")  # at most n rows

    def retrieve(self, query: str, k: int = 5, kind: str = "hybrid") -> list[dict]:
        key = ResultCache.key(query, k, kind)
        if (hit := self.cache.get(key)) is not None:
            return hit
        text = self.rewrite(query) if self.rewrite else query
        out = self.search(text, k, kind)
        if self.reranker:
            out = rerank(out, query, reranker=self.reranker)
        if kind == "semantic":
            out = out.where(F.col("similarity") >= self.floor)
        rows = [r.asDict() for r in out.orderBy(F.desc("similarity"), "id").limit(k).collect()]  # k rows
        self.cache.set(key, rows)
        return rows


def format_context(rows: list[dict]) -> str:
    """R-07."""
    return "\n\n".join(f"--- Source [{n}] {r.get('title') or r.get('source') or r['id']} (relevance: {r['similarity']:.2f})\n{r['content']}" for n, r in enumerate(rows, 1))


def expand_queries(query: str, generator=None, n: int = 3) -> list[str]:
    """R-09: the query and up to n rewritings, each once, in order; the query alone if there is no generator."""
    lines = [x.strip("-*0123456789. \t") for x in generator.generate(f"Rewrite in {n} ways, one per line: {query}").split("\n")] if generator else []
    return list(dict.fromkeys([query, *[x for x in lines if x][:n]]))


def adjacent(chunks: DataFrame, hits: DataFrame, n: int = 1) -> DataFrame:
    """R-10: each hit's chunk with those up to n before and after it, joined by an empty line."""
    h = hits.select("document_id", F.col("chunk_index").alias("_at")).withColumn("chunk_index", F.explode(F.sequence(F.col("_at") - n, F.col("_at") + n)))
    near = h.join(chunks, ["document_id", "chunk_index"])
    packed = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return near.groupBy("document_id", F.col("_at").alias("chunk_index")).agg(F.array_join(F.transform(packed, lambda s: s["content"]), "\n\n").alias("content"))


def sections(chunks: DataFrame, hits: DataFrame, section: str = "section") -> DataFrame:
    """R-11: each hit's whole section."""
    key = hits.select("document_id", section).distinct()
    packed = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.join(key, ["document_id", section], "left_semi").groupBy("document_id", section).agg(F.array_join(F.transform(packed, lambda s: s["content"]), "\n\n").alias("content"))


def is_analytical(c):
    """R-12: whether a question asks for figures; words that need text override."""
    ask = c.rlike(r"(?i)\b(how many|count|average|total|sum|list all|top \d+|most|least|per month|trend)\b")
    text = c.rlike(r"(?i)\b(why|explain|describe|summari[sz]e|what does .* say|quote)\b")
    return ask & ~text


def fuse_graph_and_text(entities: DataFrame, relations: DataFrame, texts: DataFrame, most_entities: int = 10, related: int = 5) -> DataFrame:
    """R-13: (part, rank, line): at most 10 entities, for the first five of them at most five relations each, then text."""
    w = Window.orderBy(F.desc("score"), "name")
    e = entities.orderBy(F.desc("score"), "name").limit(most_entities).withColumn("rank", F.row_number().over(w))
    r = relations.join(F.broadcast(e.where(F.col("rank") <= related).select(F.col("name").alias("src"), F.col("rank").alias("er"))), "src")
    r = top_per_group(r, ["src"], [F.asc("rel_type"), F.asc("dst")], related)
    t = texts.orderBy(F.desc("score"), "line").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "line")))
    parts = e.select(F.lit("entity").alias("part"), "rank", F.col("name").alias("line"))
    parts = parts.unionByName(r.select(F.lit("relation").alias("part"), (F.col("er") * 10 + F.col("rn")).alias("rank"), F.concat_ws(" ", "src", "rel_type", "dst").alias("line")))
    return parts.unionByName(t.select(F.lit("text").alias("part"), "rank", "line"))


class MemoryStore:
    """R-14: memories by user: add, search, all, delete, history; rows in a DataFrame, similarity by embedding."""

    def __init__(self, spark, embedder=None):
        self.spark, self.embedder, self.log, self.live = spark, embedder or HashEmbedder(), [], OrderedDict()

    def add(self, user: str, text: str) -> str:
        mid = hashlib.md5(f"{user}|{text}".encode()).hexdigest()[:12]
        self.live[(user, mid)] = text
        self.log.append((user, mid, "ADD", text))
        return mid

    def delete(self, user: str, mid: str) -> bool:
        text = self.live.pop((user, mid), None)
        if text is not None:
            self.log.append((user, mid, "DELETE", text))
        return text is not None

    def get_all(self, user: str) -> list[tuple[str, str]]:
        return [(m, t) for (u, m), t in self.live.items() if u == user]

    def history(self, user: str, mid: str) -> list[str]:
        return [op for u, m, op, _ in self.log if (u, m) == (user, mid)]

    def search(self, user: str, query: str, k: int = 5) -> list[tuple[str, str, float]]:
        own = self.get_all(user)
        if not own:
            return []
        df = self.spark.createDataFrame([(m, t, self.embedder.embed([t])[0]) for m, t in own], "id string, text string, embedding array<double>")
        got = df.select("id", "text", vectors.cosine("embedding", self.embedder.embed([query])[0]).alias("s")).orderBy(F.desc("s"), "id").limit(k)
        return [tuple(r) for r in got.collect()]


# metrics of ranked lists -------------------------------------------------------------------------------------------


def relevance(results: DataFrame, gold: DataFrame) -> DataFrame:
    """E-01: (query, rank from 1, rel, total): a result is relevant if its source contains one of the gold stems."""
    j = results.join(gold, "query")
    hit = F.exists("stems", lambda s: F.contains(F.lower(F.col("source")), F.lower(s)))
    return j.select("query", "rank", hit.cast("int").alias("rel"), F.size("stems").alias("total"))


def ranking_metrics(rel: DataFrame, k: int) -> DataFrame:
    """E-02 to E-06 per query. Hit rate is of the whole list, the others are cut at k; precision divides by k; recall
    divides by the number of stems, so it may pass 1; the ideal gain is of the relevant results in the list."""
    at = F.col("rank") <= k
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    g = rel.groupBy("query").agg(
        F.max("rel").cast("double").alias("hit"),
        F.coalesce(1.0 / F.min(F.when(at & (F.col("rel") == 1), F.col("rank"))), F.lit(0.0)).alias("rr"),
        (F.sum(F.when(at, F.col("rel")).otherwise(0)) / k).alias("precision"),
        (F.sum(F.when(at, F.col("rel")).otherwise(0)) / F.max("total")).alias("recall"),
        F.sum(F.when(at, gain).otherwise(0.0)).alias("dcg"),
        F.least(F.sum(F.when(at, F.col("rel")).otherwise(0)), F.lit(k)).cast("int").alias("n"),
    )
    ideal = F.when(F.col("n") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    return g.withColumn("ndcg", F.coalesce(F.col("dcg") / ideal, F.lit(0.0))).drop("dcg", "n")


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """E-07."""
    return per_query.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("hit", "rr", "precision", "recall", "ndcg")])


def run_report(log: DataFrame) -> DataFrame:
    """E-08: of rows (expected, intent, valid, rows, ms): shares of matched intents, valid queries and results; latency."""
    return log.agg(F.avg((F.col("expected") == F.col("intent")).cast("double")).alias("intent_match"), F.avg(F.col("valid").cast("double")).alias("valid"), F.avg((F.col("rows") > 0).cast("double")).alias("hit"), F.avg("ms").alias("mean_ms")).crossJoin(exact_percentiles(log, [], "ms", 0.95, "exclusive", least=20, name="p95_ms").drop("n"))  # one row each


BM = search.bm25_sql(["ertion", "lyer", "the"])
LEN = "ov AS (SELECT id, CAST(len(list_intersect(['ertion','lyer','the'], t)) AS DOUBLE) / 3 AS score FROM tok)"


def _arms(spark, d, base: int):
    docs = table(spark, d, "documents")
    own = F.array(*[F.lit(w) for w in ("ertion", "lyer", "the")])
    overlap = docs.select(F.col("doc_id").alias("id"), (F.size(F.array_intersect(search.tokens(F.col("text")), own)) / 3).alias("score")).where("score > 0")
    bm = search.bm25(docs, "the ertion lyer").select("id", F.round("score", 9).alias("score"))
    return [ranked(bm, "score", "id", base, 60), ranked(overlap, "score", "id", base, 60)]


def _rrf_sql(base: int, n: int) -> str:
    rn = f"row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 + {base}"
    return f"WITH {BM}, {LEN}, a AS (SELECT id, {rn} AS rank FROM bm QUALIFY rank < {60 + base}), b AS (SELECT id, {rn} AS rank FROM ov WHERE score > 0 QUALIFY rank < {60 + base}), f AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min(arm * 1000 + rank) AS o FROM (SELECT *, 0 AS arm FROM a UNION ALL SELECT *, 1 FROM b) u GROUP BY id) SELECT id, CAST(round(CAST(score AS DECIMAL(38,12)), 8) AS DOUBLE) AS score FROM f ORDER BY f.score DESC, o LIMIT {n}"


@R.query("rrf_hybrid", "R-01", _rrf_sql(0, 10))
def _(spark, d):
    return fused_top(_arms(spark, d, 0), "id", 10).select("id", decimal("score", 8).alias("score"))


@R.query("rrf_one_based", "R-02 R-03", _rrf_sql(1, 25))
def _(spark, d):
    return fused_top(_arms(spark, d, 1), "id", 25).select("id", decimal("score", 8).alias("score"))


@R.query("ev_ranking_metrics", "E-01 E-02 E-03 E-04 E-05 E-06", "WITH r AS (SELECT lang AS query, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, CASE WHEN contains(source, 'src1') OR contains(source, 'src7') THEN 1 ELSE 0 END AS rel FROM documents), t AS (SELECT * FROM r WHERE rank <= 20), g AS (SELECT query, CAST(max(rel) AS DOUBLE) AS hit, coalesce(1.0 / min(CASE WHEN rank <= 10 AND rel = 1 THEN rank END), 0) AS rr, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS n, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg FROM t GROUP BY 1) SELECT query, hit, round(rr, 6) AS rr, round(n / 10.0, 6) AS precision, round(n / 2.0, 6) AS recall, CAST(round(CAST(coalesce(dcg / list_sum(list_transform(range(1, CAST(n AS INT) + 1), lambda i: 1 / log2(i + 1))), 0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS ndcg FROM g".replace("round(n / 10.0, 6)", "CAST(round(n / 10.0, 6) AS DOUBLE)").replace("round(n / 2.0, 6)", "CAST(round(n / 2.0, 6) AS DOUBLE)").replace("round(rr, 6) AS rr", "CAST(round(CAST(rr AS DECIMAL(38,12)), 6) AS DOUBLE) AS rr"))
def _(spark, d):
    docs = table(spark, d, "documents")
    res = top_per_group(docs.select(F.col("lang").alias("query"), "source", "n_chars", "doc_id"), ["query"], [F.desc("n_chars"), F.asc("doc_id")], 20).withColumnRenamed("rn", "rank")
    gold = docs.select(F.col("lang").alias("query")).distinct().withColumn("stems", F.array(F.lit("SRC1"), F.lit("src7")))
    m = ranking_metrics(relevance(res, gold), 10)
    return m.select("query", "hit", *[decimal(c, 6).alias(c) for c in ("rr", "precision", "recall", "ndcg")])


_MEAN = "CAST(round(CAST(avg({0}) AS DECIMAL(38,12)), 6) AS DOUBLE) AS {0}"
MEANS_SQL = f"""WITH r AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, CAST(contains(lower(source), 'src1') AS INT) AS rel FROM documents),
q AS (
    SELECT lang, CAST(max(rel) AS DOUBLE) AS hit, coalesce(1.0 / min(CASE WHEN rank <= 5 AND rel = 1 THEN rank END), 0) AS rr,
        sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS n, sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg
    FROM r WHERE rank <= 10 GROUP BY 1),
m AS (
    SELECT hit, CAST(rr AS DOUBLE) AS rr, n / 5.0 AS precision, CAST(n AS DOUBLE) AS recall,
        coalesce(dcg / list_sum(list_transform(range(1, CAST(n AS INT) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg FROM q)
SELECT count(*) AS queries, {', '.join(_MEAN.format(c) for c in ('hit', 'rr', 'precision', 'recall', 'ndcg'))} FROM m"""


@R.query("ev_mean_metrics", "E-07", MEANS_SQL)
def _(spark, d):
    docs = table(spark, d, "documents")
    res = docs.select(F.col("lang").alias("query"), "source", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("rank")).where("rank <= 10")
    gold = docs.select(F.col("lang").alias("query")).distinct().withColumn("stems", F.array(F.lit("src1")))
    m = mean_metrics(ranking_metrics(relevance(res, gold), 5))
    return m.select("queries", *[decimal(c, 6).alias(c) for c in ("hit", "rr", "precision", "recall", "ndcg")])


@R.query("rt_adjacent", "R-10", "SELECT a.conv_id, a.turn AS chunk_index, string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn) AS content FROM (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 1) a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY 1, 2")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return adjacent(c, c.where("chunk_index % 3 = 1"), 1).select(F.col("document_id").alias("conv_id"), "chunk_index", "content")


@R.query("rt_sections", "R-11", "SELECT conv_id, role, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations WHERE (conv_id, role) IN (SELECT conv_id, role FROM conversations WHERE turn = 1) GROUP BY 1, 2")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), F.col("role").alias("section"))
    return sections(c, c.where("chunk_index = 1")).select(F.col("document_id").alias("conv_id"), F.col("section").alias("role"), F.md5("content").alias("h"))


@R.query("rt_intent", "R-12", "SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(how many|count|average|total|sum|list all|top \\d+|most|least|per month|trend)\\b') AND NOT regexp_matches(text, '(?i)\\b(why|explain|describe|summari[sz]e|what does .* say|quote)\\b') AS analytical FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", is_analytical(F.col("text")).alias("analytical"))


@R.query("rt_retrieve_hybrid", "R-04 FT-14 V-06")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("source").alias("title"), "source")
    return Retriever(embed_column(docs, "content", HashEmbedder())).search("the ertion lyer", 10).select("id", "similarity")


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
