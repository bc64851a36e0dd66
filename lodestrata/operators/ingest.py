"""Documents to chunks: incremental ingestion, chunkers, table text, topic scoring and clustering."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import scratch, ship, table
from .rewrites import decimal

R = Registry()


@dataclass(frozen=True)
class ChunkingConfig:
    size: int = 1000
    overlap: int = 200
    most: int = 2000
    least: int = 100
    tokens: int = 512

    def __post_init__(self):
        if self.overlap >= self.size:
            raise ValueError("overlap must be less than size")
        if self.least <= 0:
            raise ValueError("least must be positive")


def classify_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """I-01: (source, state) with state new, changed, unchanged or deleted, by hash."""
    j = files.select("source", F.col("hash").alias("_n")).join(stored.select("source", F.col("hash").alias("_o")), "source", "full")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_n") == F.col("_o"), "unchanged").otherwise("changed")
    return j.select("source", state.alias("state"))


#: Characters that end a window, and how far back from its full size they are looked for.
STOPS, LOOK_BACK = ".!?\n", 200


def sliding_chunks(text: str, c: ChunkingConfig = ChunkingConfig()) -> list[tuple[int, int, int, str]]:
    """I-02: (index, start, end, content). A window of full size, unless it reaches the text's end, ends after its last
    stop no more than LOOK_BACK back and beyond the least size; the next starts overlap before that end. Blank windows
    go; the last may lie within the one before, and its end beyond the text."""
    out, start = [], 0
    while start < len(text):
        end = start + c.size
        if end < len(text):
            stop = max(text.rfind(x, max(start + c.least, end - LOOK_BACK) + 1, end + 1) for x in STOPS)
            end = stop + 1 if stop >= 0 else end
        if body := text[start:end].strip():
            out.append((len(out), start, end, body))
        start = max(start + 1, end - c.overlap)
    return out


def by_arrow(df: DataFrame, key: str, text: str, f, schema: str) -> DataFrame:
    """One row to many, by Arrow batches: f(text) gives the rows' tuples after the key."""

    def run(batches):
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text]) if isinstance(t, str) for r in f(t)]
            yield pd.DataFrame(rows, columns=cols)

    cols = [key] + [x.split()[0] for x in schema.split(",")]
    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")


def chunk_window(df: DataFrame, key: str, text: str, c: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    def f(t):
        return [(*x, len(x[3]) // 4) for x in sliding_chunks(t, c)]

    return by_arrow(df, key, text, f, "chunk_index int, start_char int, end_char int, content string, token_count int")


def chunk_stride(df: DataFrame, key: str, text: str, stride: int = 1500) -> DataFrame:
    """I-07: pieces of a fixed number of characters, as expressions."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return df.select(key, text, F.posexplode(starts).alias("chunk_index", "start")).select(key, "chunk_index", F.substring(F.col(text), F.col("start") + 1, F.lit(stride)).alias("content"))


def sentences(c: Column) -> Column:
    """I-04: split after . ! ? and white space (RE2's, without the vertical tab), trimmed, those over ten characters."""
    parts = F.split(F.regexp_replace(c, r"([.!?])[ \t\n\f\r]+", "$1\n"), "\n")
    # F.trim by itself would also be given an item's place, and trim its digits
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def semantic_chunks(text: str, embed, threshold: float = 0.5, least: int = 2, most: int = 15, adaptive: bool = False, min_chars: int = 100, max_chars: int = 2000) -> list[tuple[int, str]]:
    """I-05, I-06, W-21: sentences in a row until a neighbour's similarity falls under the threshold (adaptive: the
    text's 25th percentile, with bounds on characters) or there are most of them."""
    ss = [s for s in (x.strip() for x in re.sub(r"([.!?])\s+", r"\1\n", text).split("\n")) if len(s) > 10]
    if len(ss) < 2 or (not adaptive and len(text) < 200):
        return [(0, text.strip())] if text.strip() else []
    v = embed(ss)
    sims = [sum(a * b for a, b in zip(x, y)) for x, y in zip(v, v[1:])]
    if adaptive:
        o = sorted(sims)
        at = 0.25 * (len(o) - 1)
        threshold = o[int(at)] + (at - int(at)) * (o[min(int(at) + 1, len(o) - 1)] - o[int(at)])
    out, now = [], [ss[0]]
    for s, sim in zip(ss[1:], sims):
        size = sum(map(len, now))
        cut = (sim < threshold and size >= min_chars) or size >= max_chars if adaptive else (sim < threshold and len(now) >= least) or len(now) >= most
        if cut:
            out.append(" ".join(now))
            now = []
        now.append(s)
    return list(enumerate([*out, " ".join(now)]))


def heading_chunks(text: str) -> list[tuple[int, str, str]]:
    """I-03: (index, heading path, content) of Markdown by its headings."""
    path, out, body = [], [], []

    def flush():
        if (s := "\n".join(body).strip()):
            out.append((len(out), " > ".join(h for _, h in path), s))
        body.clear()

    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2].strip()))
        else:
            body.append(line)
    flush()
    return out


def keyword_scores(df: DataFrame, key: str, text: Column, words: dict[str, list[str]]) -> DataFrame:
    """I-17, I-18: (key, label, score): how many of a label's words the text has, labels without any left out."""
    parts = [F.struct(F.lit(label).alias("label"), sum((F.contains(F.lower(text), F.lit(w.lower())).cast("int") for w in ws), F.lit(0)).alias("score")) for label, ws in words.items()]
    return df.select(key, F.explode(F.array(*parts)).alias("s")).select(key, "s.label", "s.score").where("score > 0")


def theme_scores(meetings: DataFrame, words: dict[str, list[str]], boosts: dict[str, list[tuple[str, int]]], scan: str = "concern") -> DataFrame:
    """I-17: of meetings (id, topics array, signals array, summary): words per topic, boosts per signal, and the
    summary's words if the scanned signal is there."""
    t = keyword_scores(meetings.select("id", F.explode("topics").alias("t")), "id", F.col("t"), words)
    b = meetings.sparkSession.createDataFrame([(s, label, n) for s, xs in boosts.items() for label, n in xs], "signal string, label string, score int")  # a few rows
    g = meetings.select("id", F.explode(F.array_distinct("signals")).alias("signal")).join(F.broadcast(b), "signal").select("id", "label", "score")
    c = keyword_scores(meetings.where(F.array_contains("signals", scan)), "id", F.col("summary"), words)
    return t.unionByName(g).unionByName(c).groupBy("id", "label").agg(F.sum("score").cast("long").alias("score"))


def primary(scores: DataFrame, order: dict[str, int] | None = None) -> DataFrame:
    """A-35: the label of the highest score, ties by the order of first mention (else by name), and its confidence."""
    rank = F.coalesce(*[F.when(F.col("label") == k, n) for k, n in (order or {}).items()], F.lit(10_000))
    w = Window.partitionBy("id").orderBy(F.desc("score"), rank, "label")
    d = scores.withColumn("rn", F.row_number().over(w))
    return d.where("rn = 1").select("id", "label", "score", F.least(F.lit(0.95), 0.45 + F.col("score") * 0.15).alias("confidence"))


def sentiment_features(moments: DataFrame, key: str, kind: Column) -> DataFrame:
    """A-36: counts and shares of positive and negative moments, and the net."""
    g = moments.groupBy(key).agg(F.count("*").alias("n"), F.count_if(kind == "positive").alias("pos"), F.count_if(kind == "negative").alias("neg"))
    return g.withColumns({"pos_ratio": F.col("pos") / F.nullif(F.col("n"), F.lit(0)), "neg_ratio": F.col("neg") / F.nullif(F.col("n"), F.lit(0)), "net": F.col("pos") - F.col("neg")})


#: Terms that a task counts before it hands them on, and words that are sent to all tasks.
TERMS, SENT_WORDS = 1 << 18, 1 << 20


def _runs(t: list[str], n: int, kept=None) -> list[str]:
    """The n-grams of words in order, of kept ones if they are given."""
    if kept is None:
        return [" ".join(x) for x in zip(*(t[k:] for k in range(n)))]
    if n == 2:
        return [f"{a} {b}" for a, b in zip(t, t[1:]) if a in kept and b in kept]
    on = [w in kept for w in t]
    return [" ".join(t[k : k + n]) for k in range(len(t) - n + 1) if on[k] and all(on[k : k + n])]


def _counted(t: DataFrame, sizes: range, kept=None) -> DataFrame:
    """(term, n, docs): how often and in how many texts each n-gram of these sizes occurs."""

    def run(batches):
        import pyarrow as pa

        def rows():
            return pa.record_batch([pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[x] for x in n], pa.int64())], names=["term", "n", "docs"])

        n, docs, own = Counter(), Counter(), kept.value if kept is not None else None
        for b in batches:
            for text in b["t"].to_pylist():
                words = re.findall("[a-z0-9]+", text)
                c = Counter(words) if 1 in sizes else Counter()
                for size in sizes:
                    if size > 1:
                        c.update(_runs(words, size, own))
                n.update(c)
                docs.update(c.keys())
                if len(n) >= TERMS:
                    yield rows()
                    n.clear(), docs.clear()
        yield rows()

    return t.select("t").mapInArrow(run, "term string, n long, docs long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(t: DataFrame, rows: int, features: int, grams: int, min_df: int, max_df: float) -> list[tuple[str, int]]:
    """(term, texts that have it) of the most frequent terms of at least min_df texts and at most so great a share of them, ties by
    name. An n-gram is no more frequent than its words, so those with a word below the last of so many words are not counted."""
    fit = (F.col("docs") >= min_df) & (F.col("docs") <= max_df * rows)
    order = [F.desc("n"), F.asc("term")]
    path = scratch(t.sparkSession, "words")
    _counted(t, range(1, 2)).write.parquet(path)
    words = t.sparkSession.read.parquet(path)
    least = [r["n"] for r in words.where(fit).orderBy(*order).limit(features).select("n").collect()]
    often = words.where(F.col("n") >= (least[-1] if least and len(least) == features else 0)).select("term").limit(SENT_WORDS + 1).collect()
    kept = t.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in often)) if len(often) <= SENT_WORDS else None
    every = words.unionByName(_counted(t, range(2, grams + 1), kept)) if grams > 1 else words
    return [(r["term"], r["docs"]) for r in every.where(fit).orderBy(*order).limit(features).collect()]


def tfidf(t: DataFrame, key: str, rows: int, vocab: list[tuple[str, int]], grams: int) -> DataFrame:
    """(key, features): sparse vectors of unit length (zero where no term occurs), of lower-case texts t."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    sent = t.sparkSession.sparkContext.broadcast(({x: k for k, (x, _) in enumerate(vocab)}, [math.log((rows + 1) / (docs + 1)) for _, docs in vocab], frozenset(w for x, _ in vocab if " " in x for w in x.split(" "))))
    kind = t.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        place, weight, kept = sent.value
        for b in batches:
            at, values = [], []
            for text in b["t"].to_pylist():
                words = re.findall("[a-z0-9]+", text)
                c = Counter([place[x] for x in words if x in place])
                for n in range(2, grams + 1) if kept else ():
                    c.update([place[x] for x in _runs(words, n, kept) if x in place])
                at.append(sorted(c))
                v = [c[k] * weight[k] for k in at[-1]]
                norm = math.sqrt(sum(x * x for x in v)) or 1.0
                values.append([x / norm for x in v])
            yield pa.record_batch([b[key], pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=[key, "at", "values"])

    size = len(vocab)
    vector = F.udf(lambda at, values: Vectors.sparse(size, at, values), VectorUDT())
    return t.select(key, "t").mapInArrow(run, f"`{key}` {kind}, at array<int>, values array<double>").select(key, vector("at", "values").alias("features"))


def cluster_texts(df: DataFrame, key: str, text: str, k: int = 8, features: int = 10_000, grams: int = 3, min_df: int = 2, max_df: float = 0.85, seed: int = 42):
    """I-20, I-23: TF-IDF over word n-grams, unit length, k-means: (assignments, silhouette, top terms by cluster). Vectors are
    made once and stored."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    spark = df.sparkSession
    ship(spark)
    t = df.select(key, F.coalesce(F.lower(F.col(text)), F.lit("")).alias("t"))
    rows = df.count()
    vocab = vocabulary(t, rows, features, grams, min_df, max_df)
    path = scratch(spark, "tfidf")
    tfidf(t, key, rows, vocab, grams).write.parquet(path)
    stored = spark.read.parquet(path)
    model = KMeans(k=k, seed=seed, maxIter=20).fit(stored)
    out = model.transform(stored)
    names = [x for x, _ in vocab]
    top = [[names[j] for j in sorted(range(len(names)), key=lambda j: (-c[j], names[j]))[:10]] for c in model.clusterCenters()]
    return out.select(key, F.col("prediction").alias("cluster")), ClusteringEvaluator().evaluate(out), top


def weighted_text(c: dict[str, int]) -> Column:
    """I-24: columns of text or arrays repeated so many times each, in one text."""
    return F.concat_ws(" ", *[F.col(k) for k, n in c.items() for _ in range(n)])


def assign_themes(topics: DataFrame, lookup: DataFrame) -> DataFrame:
    """I-22, I-21: (id, theme, n, is_primary): topics (id, topic, position) looked up by phrase; ties by first position."""
    j = topics.join(lookup, F.lower(F.trim("topic")) == F.col("phrase")).groupBy("id", "theme").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    return j.select("id", "theme", "n", (F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "p", "theme")) == 1).alias("is_primary"))


WORDS = {"reliability": ["thing", "ertion"], "billing": ["der ", "und"], "roadmap": ["que", "ment"]}


@R.query("in_chunk_stride", "I-07", "SELECT doc_id, CAST(s // 1500 AS INT) AS chunk_index, md5(substr(text, s + 1, 1500)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1500)) AS s FROM documents) t")
def _(spark, d):
    return chunk_stride(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", F.md5("content").alias("h"))


WINDOW_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, text, CAST(0 AS BIGINT) AS s, CASE WHEN length(text) > 1000 AND k > 0 THEN 801 + k ELSE 1000 END AS e
    FROM (SELECT doc_id, text, length(regexp_extract(substr(text, 802, 200), '(?s)^(.*[.!?\n])', 1)) AS k FROM documents WHERE length(text) > 0) t
    UNION ALL
    SELECT doc_id, text, s, CASE WHEN s + 1000 < length(text) AND k > 0 THEN s + 801 + k ELSE s + 1000 END
    FROM (SELECT doc_id, text, s, length(regexp_extract(substr(text, s + 802, 200), '(?s)^(.*[.!?\n])', 1)) AS k
        FROM (SELECT doc_id, text, greatest(s + 1, e - 200) AS s FROM w) x WHERE s < length(text)) y),
bodies AS (SELECT doc_id, s, e, regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS body FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, CAST(s AS INT) AS start_char, CAST(e AS INT) AS end_char,
    CAST(length(body) // 4 AS INT) AS token_count
FROM bodies WHERE body <> ''
"""


@R.query("in_chunk_window", "I-02", WINDOW_SQL)
def _(spark, d):
    return chunk_window(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "start_char", "end_char", "token_count")


@R.query("in_semantic_chunks", "I-05 I-06 W-21 V-08")
def _(spark, d):
    from ..providers import HashEmbedder

    e = HashEmbedder(32)

    def f(t):
        return semantic_chunks(t, e.embed)

    return by_arrow(table(spark, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k", "text", f, "chunk_index int, content string")


@R.query("in_sentences", "I-04", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))), ' ') AS s FROM documents) t WHERE length(s) > 10 GROUP BY doc_id")
def _(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n")).where("n > 0")
    return n.groupBy("doc_id").agg(F.sum("n").alias("n"))


@R.query("in_hash_diff", "I-01", "SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM (SELECT doc_id, md5(CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) n FULL JOIN (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0) o ON n.doc_id = o.doc_id GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("source"), "text")
    new = t.where("source % 4 <> 0").withColumn("hash", F.md5(F.when(F.col("source") % 9 == 0, "x").otherwise(F.col("text"))))
    return classify_files(new, t.where("source % 5 <> 0").withColumn("hash", F.md5("text"))).groupBy("state").agg(F.count("*").alias("n"))


@R.query("in_keyword_scores", "I-17", "SELECT doc_id, label, CAST(score AS BIGINT) AS score FROM (SELECT doc_id, 'reliability' AS label, CAST(contains(lower(text), 'thing') AS INT) + CAST(contains(lower(text), 'ertion') AS INT) AS score FROM documents UNION ALL SELECT doc_id, 'billing', CAST(contains(lower(text), 'der ') AS INT) + CAST(contains(lower(text), 'und') AS INT) FROM documents UNION ALL SELECT doc_id, 'roadmap', CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'ment') AS INT) FROM documents) t WHERE score > 0")
def _(spark, d):
    return keyword_scores(table(spark, d, "documents"), "doc_id", F.col("text"), WORDS).withColumn("score", F.col("score").cast("long"))


@R.query("in_call_type", "I-18 A-35", "WITH s AS (SELECT doc_id, label, score FROM (SELECT doc_id, 'reliability' AS label, CAST(contains(lower(text), 'thing') AS INT) + CAST(contains(lower(text), 'ertion') AS INT) AS score FROM documents UNION ALL SELECT doc_id, 'billing', CAST(contains(lower(text), 'der ') AS INT) + CAST(contains(lower(text), 'und') AS INT) FROM documents UNION ALL SELECT doc_id, 'roadmap', CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'ment') AS INT) FROM documents) t WHERE score > 0) SELECT doc_id AS id, label, CAST(round(CAST(least(0.95, 0.45 + score * 0.15) AS DECIMAL(38,12)), 4) AS DOUBLE) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1")
def _(spark, d):
    s = keyword_scores(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", F.col("text"), WORDS)
    return primary(s).select("id", "label", decimal("confidence", 4).alias("confidence"))


@R.query("in_sentiment", "A-36", "SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE turn % 3 = 0) AS pos, count(*) FILTER (WHERE turn % 3 = 1) AS neg, CAST(round(CAST(count(*) FILTER (WHERE turn % 3 = 0) * 1.0 / count(*) AS DECIMAL(38,12)), 6) AS DOUBLE) AS pos_ratio FROM conversations GROUP BY conv_id")
def _(spark, d):
    kind = F.when(F.col("turn") % 3 == 0, "positive").when(F.col("turn") % 3 == 1, "negative").otherwise("none")
    return sentiment_features(table(spark, d, "conversations"), "conv_id", kind).select("conv_id", "n", "pos", "neg", decimal("pos_ratio", 6).alias("pos_ratio"))


@R.query("in_themes", "I-22 A-35", "WITH t AS (SELECT o_custkey AS id, o_orderpriority AS theme, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY 1, 2) SELECT id, theme, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, p, theme) = 1 AS is_primary FROM t")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("position"))
    return assign_themes(o, o.select(F.lower("topic").alias("phrase"), F.col("topic").alias("theme")).distinct())


@R.query("in_cluster_texts", "I-23 I-24")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", weighted_text({"text": 1, "lang": 3}).alias("text"))
    return cluster_texts(t, "doc_id", "text", k=4, features=500, grams=2)[0]


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
