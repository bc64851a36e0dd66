"""A stored inverted index with block-max top-k search.

Postings (bucket, term, block, id, tf, n) are written once: partitioned by a hash of the term, sorted by term and block
within files, so a question reads its terms' partitions and, by the statistics of pages, little else of them. Texts of
about the same length share blocks of about ``block`` of them, dealt by a hash of the id; no numbering of the corpus is
needed. Beside the postings stand the dictionary (term, df, top), with the largest weight that a term has in any text,
and the heads (term, block, top) of terms that have more postings than a block has texts.

A search bounds the score of each block by the sum of its heads, scores the blocks of the largest bounds, and then only
those whose bound reaches the k-th score found. Scores are exact; what is left out can't be among the first k.

Defined results: null texts are no documents, empty ones are; rows that share an id are documents of their own whose
scores add up; scores that agree in nine decimals are ties, which go by id; terms that no text has add nothing; a question without terms has no answers.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow_words import numbered_words, only, runs
from ..plans.registry import Registry
from ..session import scratch, ship, table
from .rewrites import decimal
from .search import TOK, bm25_sql, words

R = Registry()
#: Frequent terms that are sent to all tasks (some 20 MB) rather than joined.
SENT_TERMS = 500_000


LETTERS = only("abcdefghijklmnopqrstuvwxyz0123456789", beyond=False)


def _class(n):
    """Lengths within a factor of the square root of two share a class."""
    import numpy as np

    return np.floor(2 * np.log2(n + 1.0)).astype(np.int64)


def _lengths(batches):
    """(class, docs, words) of batches (text), summed up."""
    import numpy as np
    import pyarrow as pa

    docs, total = np.zeros(128, np.int64), np.zeros(128, np.int64)
    for t, row, _, _ in numbered_words(batches, 0, LETTERS):
        n = np.bincount(row, minlength=t.num_rows)
        np.add.at(docs, _class(n), 1)
        np.add.at(total, _class(n), n)
    on = np.flatnonzero(docs)
    yield pa.record_batch([pa.array(on), pa.array(docs[on]), pa.array(total[on])], names=["class", "docs", "words"])


def _postings(buckets: int, start, blocks):
    """(id, n, term, tf, block, bucket) of batches (id, hash, text): a row for each term of each text. A class's texts are
    dealt to its blocks by the hash."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t, row, code, terms in numbered_words(batches, 2, LETTERS):
            if not len(row):
                continue
            size, ids = max(1, len(terms)), pa.concat_arrays(t.column(0).chunks)
            n = np.bincount(row, minlength=t.num_rows)
            c = _class(n)
            block = start[c] + t.column(1).to_numpy() % np.maximum(blocks[c], 1)
            bucket = np.array([zlib.crc32(w) % buckets for w in terms.cast(pa.large_binary()).to_pylist()], np.int32)
            key, tf = runs(row * size + code)
            for k in range(0, len(key), 1 << 16):
                s = slice(k, k + (1 << 16))
                at, term = key[s] // size, key[s] % size
                columns = [ids.take(pa.array(at)), pa.array(n[at].astype(np.int32)), terms.take(pa.array(term)).cast(pa.string()), pa.array(tf[s].astype(np.int32)), pa.array(block[at]), pa.array(bucket[term])]
                yield pa.record_batch(columns, names=["id", "n", "term", "tf", "block", "bucket"])

    return run


#: What is written; without rows there is nothing that a schema could be read from.
_SCHEMAS = {"postings": "id {id}, n int, term string, tf int, block long", "dictionary": "term string, df long, tf long, top double", "heads": "term string, block long, top double, n long"}


@dataclass
class Index:
    """Where an index is and what it holds; ``open_index`` reads this from the table beside the postings."""

    path: str
    docs: int
    mean: float
    buckets: int
    block: int
    k1: float
    b: float
    kind: str

    def _of(self, spark: SparkSession, name: str, terms: list[str]) -> DataFrame:
        own = spark.read.schema(f"{_SCHEMAS[name].format(id=self.kind)}, bucket int").parquet(f"{self.path}/{name}")
        return own.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})) & F.col("term").isin(terms))

    def weight(self) -> Column:
        return F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("n") / F.lit(self.mean)))

    def idf(self, spark: SparkSession, terms: list[str]) -> dict[str, tuple[float, int]]:
        """(idf, df) of the terms that the index has: a row for each term of the question."""
        found = self._of(spark, "dictionary", terms).select("term", "df").collect()
        return {r["term"]: (math.log(1 + (self.docs - r["df"] + 0.5) / (r["df"] + 0.5)), r["df"]) for r in found}

    def postings(self, spark: SparkSession, question: str) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
        terms = sorted(set(words(question)))
        known = self.idf(spark, terms)
        p = self._of(spark, "postings", sorted(known))
        return p.withColumn("score", self.weight() * _by_term(known)), known

    def scores(self, spark: SparkSession, question: str) -> DataFrame:
        """(id, score) of all texts with any of the terms."""
        p, _ = self.postings(spark, question)
        return p.groupBy("id").agg(F.sum("score").alias("score"))

    def match_all(self, spark: SparkSession, question: str) -> DataFrame:
        """FT-02: ids of texts with every term."""
        terms = sorted(set(words(question)))
        p, known = self.postings(spark, question)
        if len(known) < len(terms):
            p = p.limit(0)
        return p.groupBy("id").agg(F.countDistinct("term").alias("k")).where(F.col("k") == len(terms)).select("id")

    def bounds(self, spark: SparkSession, question: str) -> DataFrame:
        """(block, bound): no text of the block scores higher. Heads of frequent terms are stored; a rare term has at most a
        block's worth of postings, whose scores themselves are the bound."""
        p, known = self.postings(spark, question)
        often = sorted(t for t, (_, df) in known.items() if df > self.block)
        rare = sorted(set(known) - set(often))
        heads = self._of(spark, "heads", often).select("block", "term", (F.col("top") * _by_term(known)).alias("top"))
        few = p.where(F.col("term").isin(rare)).groupBy("block", "term").agg(F.max("score").alias("top"))
        return heads.unionByName(few.select("block", "term", "top")).groupBy("block").agg(F.sum("top").alias("bound"))

    def search(self, spark: SparkSession, question: str, k: int, lead: int = 8) -> DataFrame:
        """FT-10: (id, score) of the k best texts, by ``lead`` blocks first and those that may still hold better ones."""
        p, known = self.postings(spark, question)
        if not known or k < 1:
            return p.select("id", "score").limit(0)
        blocks, at = self._kept(self.bounds(spark, question))
        first = blocks.orderBy(F.desc("bound"), "block").limit(lead + -(-k // self.block)).select("block")
        best = p.join(F.broadcast(first), "block").groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score")).limit(k)
        n, least = best.agg(F.count("*"), F.min("score")).first()
        # bounds and scores are sums in another order, and scores are ranked by nine decimals
        hopeful = blocks.where(F.col("bound") >= (least * (1 - 1e-9) - 1e-8 if n == k else 0.0)).select("block")
        out = p.join(hopeful, "block", "left_semi").groupBy("id").agg(F.sum("score").alias("score"))
        return out.orderBy(F.desc(F.round("score", 9)), F.asc("id")).limit(k)

    def _kept(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(df.sparkSession, "bounds")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), path


def _by_term(known: dict[str, tuple[float, int]]) -> Column:
    out = F.lit(0.0)
    for t, (idf, _) in known.items():
        out = F.when(F.col("term") == t, F.lit(idf)).otherwise(out)
    return out


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 32, block: int = 256, k1: float = 1.2, b: float = 0.75) -> Index:
    """FT-01: write the index of a table of texts and open it. One shuffle, of a row for each term of each text."""
    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    path = path or scratch(spark, "index")
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.lower(text_col).alias("text"))
    classes = d.select("text").mapInArrow(_lengths, "class long, docs long, words long").groupBy("class").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()  # at most 128 rows
    total = sum(r["docs"] for r in classes)
    mean = float(sum(r["words"] for r in classes)) / max(1, total)
    start, blocks = np.zeros(128, np.int64), np.zeros(128, np.int64)
    for r in classes:
        blocks[r["class"]] = -(-r["docs"] // block)
    start[1:] = np.cumsum(blocks)[:-1]
    kind = d.schema["id"].dataType.simpleString()
    p = d.mapInArrow(_postings(buckets, start, blocks), f"id {kind}, n int, term string, tf int, block long, bucket int")
    index = Index(path, total, mean, buckets, block, k1, b, kind)
    p.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")

    def written(name: str) -> DataFrame:
        return spark.read.schema(f"{_SCHEMAS[name].format(id=kind)}, bucket int").parquet(f"{path}/{name}")

    by_term = written("postings").groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max(index.weight()).alias("top"))
    by_term.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/dictionary")
    often = written("dictionary").where(F.col("df") > block).select("bucket", "term")
    if often.count() <= SENT_TERMS:
        often = F.broadcast(often)
    heads = written("postings").join(often, ["bucket", "term"], "left_semi").groupBy("bucket", "term", "block").agg(F.max(index.weight()).alias("top"), F.count("*").alias("n"))
    heads.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/heads")
    spark.createDataFrame([(total, mean, buckets, block, k1, b, kind)], "docs long, mean double, buckets int, block int, k1 double, b double, kind string").coalesce(1).write.parquet(f"{path}/stats")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/stats").first()
    return Index(path, r["docs"], r["mean"], r["buckets"], r["block"], r["k1"], r["b"], r["kind"])


# Queries ---------------------------------------------------------------------------------------------------------


@R.query("ft_index_terms", "FT-01", f"WITH {TOK}, each AS (SELECT id, unnest(t) AS term FROM tok) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM each GROUP BY term")
def _(spark, d):
    """The dictionary of an index over all documents."""
    index = build_index(table(spark, d, "documents"))
    return spark.read.parquet(f"{index.path}/dictionary").select("term", "df", "tf")


@R.query("ft_index_search", "FT-10 FT-01", f"WITH {bm25_sql(['ertion', 'schach', 'the', 'lyer', 'nowhere'])} SELECT id, CAST(round(CAST(score AS DECIMAL(38,12)), 6) AS DOUBLE) AS score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 25")
def _(spark, d):
    """The 25 best documents for a question, from an index that is written and opened again."""
    path = build_index(table(spark, d, "documents")).path
    return open_index(spark, path).search(spark, "the ertion lyer schach nowhere", 25).select("id", decimal("score", 6).alias("score"))


@R.query("ft_index_match", "FT-02 FT-06", f"WITH {TOK} SELECT id FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'ertion') AND list_contains(t, 'and')")
def _(spark, d):
    """Documents with all of three terms."""
    return build_index(table(spark, d, "documents")).match_all(spark, "the ertion and")


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
