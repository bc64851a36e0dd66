"""Full-text search over postings: (term, id, positions). The ``simple`` configuration lower-cases and splits at what is
not a-z or 0-9; ``english`` also drops stop words and strips common suffixes.

Queries are parsed on the driver into a plan over postings; only the query's terms are read from them.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import table

R = Registry()
# English stop words.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def tokens(c: Column, config: str = "simple") -> Column:
    """Terms of a text in order."""
    t = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    if config == "simple":
        return t
    kept = F.filter(t, lambda x: ~x.isin(*STOP))
    return F.transform(kept, lambda x: F.when(F.length(x) > 4, F.regexp_replace(x, "(ational|ization|fulness|ingly|edly|ing|ed|ies|es|s|ly)$", "")).otherwise(x))


def words(text: str, config: str = "simple") -> list[str]:
    """The driver's twin of tokens, for queries."""
    t = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    if config == "simple":
        return t
    return [re.sub("(ational|ization|fulness|ingly|edly|ing|ed|ies|es|s|ly)$", "", x) if len(x) > 4 else x for x in t if x not in STOP]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: str = "simple", only: list[str] | None = None) -> DataFrame:
    """FT-01: (id, term, pos, n) with n the length of the text in terms; only the given terms, if any are given."""
    d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col), config).alias("t"))
    d = d.withColumn("n", F.size("t"))
    if only is not None:
        at = F.filter(F.transform("t", lambda x, k: F.struct(x.alias("term"), k.alias("pos"))), lambda s: s["term"].isin(*only))
        return d.select("id", "n", F.explode(at).alias("p")).select("id", "p.term", "p.pos", "n")
    return d.select("id", F.posexplode("t").alias("pos", "term"), "n").select("id", "term", "pos", "n")


def match_all(docs: DataFrame, query: str, config: str = "simple", **cols) -> DataFrame:
    """FT-02, FT-06: ids of texts with every term."""
    terms = sorted(set(words(query, config)))
    p = postings(docs, config=config, only=terms, **cols)
    return p.groupBy("id").agg(F.countDistinct("term").alias("k")).where(F.col("k") == len(terms)).select("id")


def match_phrase(docs: DataFrame, phrase: str, config: str = "simple", **cols) -> DataFrame:
    """FT-05: ids of texts with the terms next to each other: starts that all terms agree on."""
    terms = words(phrase, config)
    p = postings(docs, config=config, only=sorted(set(terms)), **cols)
    offsets = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(terms)]))
    s = p.withColumn("o", offsets).where("term = o.t").groupBy("id", (F.col("pos") - F.col("o.k")).alias("start")).agg(F.countDistinct("o.k").alias("k"))
    return s.where(F.col("k") == len(terms)).select("id").distinct()


def parse_websearch(query: str) -> list[list[tuple[str, bool]]]:
    """FT-04: alternatives (OR), each a list of (phrase or word, negated)."""
    out: list[list[tuple[str, bool]]] = [[]]
    for neg, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not neg and word.lower() == "or":
            out.append([])
        elif quoted or word:
            out[-1].append((quoted or word, bool(neg)))
    return [x for x in out if x]


def match_websearch(docs: DataFrame, query: str, config: str = "simple", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FT-04, FT-12: words, "phrases", OR and -negation."""
    cols = {"id_col": id_col, "text_col": text_col}
    found = None
    for alternative in parse_websearch(query):
        hit = None
        for text, negated in alternative:
            if not negated:
                ids = match_phrase(docs, text, config, **cols)
                hit = ids if hit is None else hit.join(ids, "id", "left_semi")
        hit = docs.select(F.col(id_col).alias("id")) if hit is None else hit
        for text, negated in alternative:
            if negated:
                hit = hit.join(match_phrase(docs, text, config, **cols), "id", "left_anti")
        found = hit if found is None else found.unionByName(hit)
    return (found if found is not None else docs.select(F.col(id_col).alias("id")).limit(0)).distinct()


def rank_tf(docs: DataFrame, query: str, config: str = "simple", weight: float = 0.1, **cols) -> DataFrame:
    """FT-03: an ordering like ts_rank: per term the weight times the harmonic sum of its occurrences, combined as
    1 - product of (1 - share)."""
    terms = sorted(set(words(query, config)))
    p = postings(docs, config=config, only=terms, **cols).groupBy("id", "term").agg(F.count("*").alias("tf"))
    share = weight * F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda a, k: a + 1 / (k * k)) / 1.64493406685
    return p.groupBy("id").agg((1 - F.exp(F.sum(F.log(1 - share)))).alias("score"))


def cover_density(positions: list[list[int]]) -> float:
    """FT-08: sum over minimal covers of all terms of 1 / (1 + noise)."""
    every = sorted((p, k) for k, ps in enumerate(positions) for p in ps)
    need, score, last = len(positions), 0.0, -1
    seen: dict[int, int] = {}
    for p, k in every:
        seen[k] = p
        if len(seen) == need:
            start = min(seen.values())
            if start > last:
                score += 1.0 / (1 + (p - start + 1 - need))
                last = start
                seen = {a: b for a, b in seen.items() if b > start}
    return score


def rank_cover(docs: DataFrame, query: str, config: str = "simple", **cols) -> DataFrame:
    """FT-08: cover density over positions, in Arrow batches of matching texts only."""
    terms = sorted(set(words(query, config)))
    p = postings(docs, config=config, only=terms, **cols).groupBy("id").agg(F.collect_list(F.struct("term", "pos")).alias("p"))

    def run(col: pd.Series) -> pd.Series:
        out = []
        for ps in col:
            by = {}
            for x in ps:
                by.setdefault(x["term"], []).append(int(x["pos"]))
            out.append(cover_density(list(by.values())) if len(by) == len(terms) else 0.0)
        return pd.Series(out)

    return p.select("id", F.pandas_udf(run, "double")("p").alias("score")).where("score > 0")


def headline(text: str, query: str, max_words: int = 35) -> str:
    """FT-07: a stretch of words around the first hit, hits in <b>."""
    terms, parts = set(words(query)), re.split(r"(\s+)", text)
    at = [k for k in range(0, len(parts), 2) if set(words(parts[k])) & terms]
    start = max(0, (at[0] if at else 0) - 2 * (max_words // 4))
    own = parts[start : start + 2 * max_words - 1]
    return "".join(f"<b>{x}</b>" if not x.isspace() and x and set(words(x)) & terms else x for x in own).strip()


def headlines(c, query: str, max_words: int = 35) -> Column:
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else headline(x, query, max_words))

    return F.pandas_udf(run, "string")(c)


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, config: str = "simple", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FT-10: (id, score) of texts with any term. One pass counts the corpus and the texts of each term, one scores the texts
    that have any; no text is shuffled."""
    terms = sorted(set(words(query, config)))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("s")).where("s is not null").select("id", tokens(F.col("s"), config).alias("t"))

    def times(w: str) -> Column:
        return F.size(F.filter("t", lambda x: x == w))

    # generated, so that no filter on the counts is pushed below and makes the tokens anew
    counts = F.struct(F.size("t").alias("n"), *[times(w).alias(f"tf{k}") for k, w in enumerate(terms)])
    d = d.select("id", F.explode(F.array(counts)).alias("h")).select("id", "h.*")
    tf = [F.col(f"tf{k}") for k in range(len(terms))]
    corpus = d.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(t > 0).alias(f"df{k}") for k, t in enumerate(tf)])

    def part(k: int) -> Column:
        idf = F.log(1 + (F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        return F.when(tf[k] > 0, idf * tf[k] * (k1 + 1) / (tf[k] + k1 * (1 - b + b * F.col("n") / F.col("mean")))).otherwise(0.0)

    s = d.where(reduce(lambda x, t: x | (t > 0), tf, F.lit(False))).crossJoin(F.broadcast(corpus))  # one row
    return s.groupBy("id").agg(F.sum(sum((part(k) for k in range(len(terms))), F.lit(0.0))).alias("score"))


def trigrams(s: str) -> set[str]:
    """Three-letter pieces of the words, two spaces before and one after each."""
    return {p[k : k + 3] for w in re.findall(r"\w+", s.lower()) for p in [f"  {w} "] for k in range(len(p) - 2)}


def word_similarity(query: str, text: str) -> float:
    """FT-11: the largest share of the query's trigrams that a stretch of the text's words has, by stretch."""
    q = trigrams(query)
    ws = re.findall(r"\w+", text.lower())
    if not q or not ws:
        return 0.0
    n = max(1, len(re.findall(r"\w+", query)))
    parts = [trigrams(w) for w in ws]
    best = 0.0
    for size in range(1, n + 1):
        for k in range(len(ws) - size + 1):
            g = set().union(*parts[k : k + size])
            if (hit := len(q & g)) and (s := hit / len(q | g) if size < n else hit / len(q)) > best:
                best = s
    return best


def trigram_similarity(a: Column, b: Column) -> Column:
    """FT-11: set similarity of two columns' trigrams, as expressions."""

    def grams(c: Column) -> Column:
        ws = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
        pads = F.transform(ws, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
        return F.array_distinct(F.flatten(F.transform(pads, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda k: F.substr(p, k, F.lit(3))))))

    x, y = grams(a), grams(b)
    both = F.size(F.array_intersect(x, y))
    return F.try_divide(both.cast("double"), F.size(x) + F.size(y) - both)


def weighted_score(docs: DataFrame, query: str, weights: dict[str, float], id_col: str = "doc_id") -> DataFrame:
    """FT-12: sum of weight times term frequency over several text columns."""
    out = None
    for c, w in weights.items():
        p = postings(docs, id_col, c, only=sorted(set(words(query)))).groupBy("id").agg((F.count("*") * float(w)).alias("s"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("id").agg(F.sum("s").alias("score"))


def or_empty(make, like: DataFrame) -> DataFrame:
    """FT-14: the arm's plan, or no rows if it cannot be built."""
    try:
        return make()
    except Exception:
        return like.limit(0)


TOK = "tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents)"


def bm25_sql(terms: list[str]) -> str:
    """The same score in DuckDB SQL."""
    ts = ", ".join(f"('{t}')" for t in terms)
    return f"{TOK}, corpus AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM tok), tf AS (SELECT id, len(t) AS n, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM tok, (VALUES {ts}) q(term)), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1), bm AS (SELECT id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN df USING (term), corpus WHERE tf > 0 GROUP BY id)"


@R.query("ft_bm25", "FT-10", f"WITH {bm25_sql(['ertion', 'the', 'lyer'])} SELECT id, CAST(round(CAST(score AS DECIMAL(38,12)), 6) AS DOUBLE) AS score FROM bm")
def _(spark, d):
    from .rewrites import decimal

    return bm25(table(spark, d, "documents"), "the ertion lyer").select("id", decimal("score", 6).alias("score"))


@R.query("ft_and_match", "FT-02 FT-06", f"WITH {TOK} SELECT id FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'ertion')")
def _(spark, d):
    return match_all(table(spark, d, "documents"), "the ertion")


@R.query("ft_phrase", "FT-05", f"WITH {TOK} SELECT id FROM tok WHERE contains(concat(' ', array_to_string(t, ' '), ' '), ' of the ')")
def _(spark, d):
    return match_phrase(table(spark, d, "documents"), "of the")


@R.query("ft_websearch", "FT-04 FT-12", f"WITH {TOK} SELECT id FROM tok WHERE (list_contains(t, 'the') AND contains(concat(' ', array_to_string(t, ' '), ' '), ' to the ') AND NOT list_contains(t, 'and')) OR list_contains(t, 'schach')")
def _(spark, d):
    return match_websearch(table(spark, d, "documents"), 'the "to the" -and OR schach')


@R.query("ft_language_config", "FT-09 FT-01", f"WITH {TOK} SELECT lang, count(*) AS n FROM documents JOIN tok ON id = doc_id WHERE list_contains(t, 'de') GROUP BY lang")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.join(match_all(docs, "de").withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@R.query("ft_weighted", "FT-12", "WITH a AS (SELECT p_partkey AS id, len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x = 'widget')) * 10.0 + len(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x = 'widget')) AS score FROM part) SELECT id, CAST(score AS DOUBLE) AS score FROM a WHERE score > 0")
def _(spark, d):
    return weighted_score(table(spark, d, "part"), "widget", {"p_name": 10.0, "p_type": 1.0}, "p_partkey")


@R.query("ft_trigram", "FT-11", "WITH g AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda k: substr(concat('  ', w, ' '), k, 3))))) AS x, list_distinct(flatten(list_transform(['standard', 'brass'], lambda w: list_transform(range(1, len(w) + 2), lambda k: substr(concat('  ', w, ' '), k, 3))))) AS y FROM part) SELECT p_partkey, CAST(round(CAST(CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))) AS DECIMAL(38,12)), 6) AS DOUBLE) AS s FROM g")
def _(spark, d):
    from .rewrites import decimal

    return table(spark, d, "part").select("p_partkey", decimal(trigram_similarity(F.col("p_type"), F.lit("standard brass")), 6).alias("s"))


@R.query("ft_rank_orders", "FT-03")
def _(spark, d):
    return rank_tf(table(spark, d, "documents"), "the ertion")


@R.query("ft_cover_density", "FT-08")
def _(spark, d):
    return rank_cover(table(spark, d, "documents"), "the ertion")


@R.query("ft_headline", "FT-07")
def _(spark, d):
    docs = table(spark, d, "documents")
    hit = match_all(docs, "ertion").withColumnRenamed("id", "doc_id")
    return docs.join(hit, "doc_id", "left_semi").select("doc_id", headlines("text", "ertion", 12).alias("snippet"))


@R.query("ft_word_similarity", "FT-11")
def _(spark, d):
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: word_similarity("standard bras", x or ""))

    return table(spark, d, "part").select("p_partkey", F.pandas_udf(run, "double")("p_type").alias("s")).where("s > 0.2")


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
