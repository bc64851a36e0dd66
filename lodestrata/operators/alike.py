"""Fuzzy deduplication of phrases: a set-similarity join and an ordered fold in rounds.

Phrases are alike if their sorted words have a longest common subsequence of at least score / 200 of their lengths together.
The fold takes phrases in order: each joins the first canonical phrase it is alike to, or becomes canonical itself.

1. Phrases with the same sorted words have the same neighbours, so one of each (the first) stands for them.
2. A common subsequence of length L of texts with S letters together leaves them at least 3 L - S - 1 common pairs of letters
   (L letters where that says nothing: then single letters are used). So the rarest few grams of each text, as many as
   may be missed and one more, meet those of any text it is alike to: texts are joined by these grams and by length, and the
   likeness of what meets is computed.
3. The fold in rounds over the links: a text without an undecided or canonical earlier neighbour is canonical, one with a
   canonical earlier neighbour is not. Each round is written before the next.

No group of phrases is gathered anywhere; what the join compares grows with the square of the phrases that share a rare
gram of about the same length. Defined results: null phrases are left out, lower-cased and trimmed phrases are
alike if equal; of equal positions the smaller phrase is first; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import common_length
from ..plans.registry import Registry
from ..session import scratch, ship, table
from .ordered import GlobalOrder

R = Registry()
#: Lengths for which the bound of common pairs of letters is looked at; beyond them it only grows.
_LENGTHS = range(2, 200)


def least_length(n: int, share: float) -> int:
    """The shortest text that may be alike to one of n letters; share = score / 200."""
    return max(1, math.ceil(share * n / (1 - share) - 1e-9)) if share < 0.5 else n


def least_common(n: int, share: float, q: int) -> int:
    """Grams that a text of n letters has in common with any it is alike to, at least."""
    s = n + least_length(n, share)
    common = math.ceil(share * s - 1e-9)
    return common if q == 1 else 3 * common - s - 1


def gram_size(score: float) -> int:
    """Pairs of letters where their bound says something for all lengths."""
    share = score / 200
    return 2 if least_length(2, share) == 2 and all(least_common(n, share, 2) > 0 for n in _LENGTHS) else 1


def _grams(text: Column, q: int) -> Column:
    """Grams of a text, equal ones numbered, so that sets of them meet as bags."""
    starts = F.sequence(F.lit(1), F.length(text) - (q - 1))
    every = F.transform(starts, lambda k: F.substr(text, k, F.lit(q)))
    # the i-th of equal grams is i steps from the start of its run in sorted order
    ordered = F.array_sort(every)
    return F.when(F.length(text) >= q, F.transform(ordered, lambda g, k: F.struct(g.alias("g"), (k - F.array_position(ordered, g) + 1).cast("int").alias("i")))).otherwise(F.array())


def alike_pairs(texts: DataFrame, score: float) -> DataFrame:
    """(early, late) positions of all rows (place, text) that are alike, for distinct texts."""
    q, share = gram_size(score), score / 200
    ship(texts.sparkSession)
    n = F.length("text")
    small = F.greatest(F.lit(1), F.ceil(share * n / F.lit(1 - share) - 1e-9)) if share < 0.5 else n
    both = n + small
    common = F.ceil(share * both - 1e-9)
    bound = common if q == 1 else 3 * common - both - 1
    t = texts.withColumns({"n": n, "shown": F.greatest((n - q + 1) - bound + 1, F.lit(1))})
    grams = t.select("place", "text", "n", "shown", F.explode(_grams(F.col("text"), q)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    w = Window.partitionBy("place").orderBy("often", "gram")
    rare = grams.join(often, "gram").withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("shown")).select("gram", "place", "text", "n")
    late = rare.select("gram", *[F.col(c).alias(f"late_{c}") for c in ("place", "text", "n")])
    near = (F.col("place") < F.col("late_place")) & (F.least("n", "late_n") >= (F.col("n") + F.col("late_n")) * share - 1e-9)
    met = rare.join(late, (rare["gram"] == late["gram"]) & near).select(F.col("place").alias("early"), F.col("late_place").alias("late"), "text", "late_text").dropDuplicates(["early", "late"])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            a, z = b.column(2).to_pylist(), b.column(3).to_pylist()
            on = [200.0 * common_length(x, y) >= score * (len(x) + len(y)) for x, y in zip(a, z)]
            yield b.select([0, 1]).filter(pa.array(on, pa.bool_()))

    return met.mapInArrow(run, "early long, late long")


def first_of_alike(links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(late, first): of links (early, late), the first canonical earlier neighbour of each text that has one."""
    spark = links.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark, "fold")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    links = kept(links)
    late = links.select(F.col("late").alias("place")).distinct()
    early = links.select(F.col("early").alias("place")).distinct()
    # 0 undecided, 1 canonical, 2 alike to a canonical one
    known, todo = early.join(late, "place", "left_anti").withColumn("state", F.lit(1)), late
    known = kept(known)
    for _ in range(max_rounds):
        if todo.isEmpty():
            break
        state = known.unionByName(todo.withColumn("state", F.lit(0))).withColumnRenamed("place", "early")
        open_links = links.join(todo.withColumnRenamed("place", "late"), "late", "left_semi").join(state, "early")
        seen = open_links.groupBy(F.col("late").alias("place")).agg(F.max(F.col("state") == 1).alias("hit"), F.max(F.col("state") == 0).alias("open"))
        new = kept(seen.withColumn("state", F.when(F.col("hit"), 2).when(~F.col("open"), 1).otherwise(0)).select("place", "state"))
        known = kept(known.unionByName(new.where("state > 0")))
        todo = new.where("state = 0").select("place")
    else:
        raise RuntimeError("the fold did not end")
    canonical = known.where("state = 1").select(F.col("place").alias("early"))
    return links.join(known.where("state = 2").select(F.col("place").alias("late")), "late", "left_semi").join(canonical, "early", "left_semi").groupBy("late").agg(F.min("early").alias("first"))


def canonical_phrases(phrases: DataFrame, score: float = 88.0) -> DataFrame:
    """I-19: (phrase, canonical, position) of all different phrases (lower-cased, trimmed) of rows (phrase, position)."""
    once = phrases.where(F.col("phrase").isNotNull()).groupBy(F.lower(F.trim("phrase")).alias("phrase")).agg(F.min("position").alias("position"))
    once = once.withColumn("text", F.array_join(F.array_sort(F.filter(F.split("phrase", r"\s+"), lambda x: x != "")), " "))
    first = once.groupBy("text").agg(F.min(F.struct("position", "phrase")).alias("f")).select("text", "f.position", "f.phrase")
    texts = GlobalOrder(first, ["position", "phrase"]).numbered("place")
    path = scratch(phrases.sparkSession, "texts")
    texts.write.parquet(path)
    texts = phrases.sparkSession.read.schema(texts.schema).parquet(path)
    joined = first_of_alike(alike_pairs(texts.select("place", "text"), score))
    own = texts.select("text", "place").join(joined.withColumnRenamed("late", "place"), "place", "left").select("text", F.coalesce("first", "place").alias("place"))
    names = own.join(texts.select("place", F.col("phrase").alias("canonical")), "place").select("text", "canonical")
    return once.join(names, "text").select("phrase", "canonical", "position")


def fuzzy_unique(phrases: DataFrame, score: float = 88.0) -> DataFrame:
    """I-19: (canonical, aliases in order) of rows (phrase, position)."""
    found = canonical_phrases(phrases, score)
    packed = F.array_sort(F.collect_list(F.when(F.col("phrase") != F.col("canonical"), F.struct("position", "phrase"))))
    return found.groupBy("canonical").agg(F.transform(packed, lambda s: s["phrase"]).alias("aliases"))


@R.query("in_fuzzy_unique", "I-19")
def _(spark, d):
    """Names of parts, and how many others each canonical one stands for."""
    parts = table(spark, d, "part").select(F.col("p_name").alias("phrase"), F.col("p_partkey").alias("position"))
    found = canonical_phrases(parts)
    return found.groupBy("canonical").agg(F.count_if(F.col("phrase") != F.col("canonical")).alias("n"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
