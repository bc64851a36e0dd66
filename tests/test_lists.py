"""The stored inverted file against brute force, on two kinds of data and odd rows; what its searches read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import lists

SCHEMA = "vec_id long, embedding array<double>"


def clustered(r, n, dim):
    centers = r.normal(size=(12, dim))
    return [centers[k % 12] + 0.35 * r.normal(size=dim) for k in range(n)]


def even(r, n, dim):
    return list(r.normal(size=(n, dim)))


def frame(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], SCHEMA)


def brute(vectors, ids, k, metric):
    x = np.array(vectors)
    out = {}
    for i in ids:
        d = 1 - x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i]) if metric == "cosine" else np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        out[i] = [int(j) for j in np.lexsort((np.arange(len(x)), np.round(d, 12)))[:k]]
    return out


def asked(df):
    return df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("make,metric", [(clustered, "cosine"), (even, "l2")])
def test_recall_and_exact(spark, make, metric):
    vectors = make(np.random.default_rng(4), 3000, 12)
    df = frame(spark, vectors)
    index = lists.build_lists(df, metric=metric)
    assert index.lists == 55 and index.rows == 3000 and index.recall >= 0.95
    assert index.probes < index.lists or make is even
    want = brute(vectors, range(0, 3000, 50), 10, metric)
    assert got(index.search_exact(asked(df), 10, others=True)) == want
    found = got(lists.open_lists(spark, index.path).search(asked(df), 10, others=True))
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)


def test_only_probed_lists_are_read(spark):
    df = frame(spark, clustered(np.random.default_rng(1), 900, 8))
    index = lists.build_lists(df)
    one = df.where("vec_id = 50").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    plan = index.search(one, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "FileScan" in x and "folder" in x]
    assert filters and all("folder#" in x.split("PartitionFilters: [")[1].split("]")[0] and "In(list" in x.split("PushedFilters: [")[1] for x in filters)


def test_a_hot_list_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lists, "BLOCK_BYTES", 8 * 4 * 50)
    r = np.random.default_rng(2)
    vectors = [np.array([1.0, 2, 3, 4])] * 700 + even(r, 300, 4)
    df = frame(spark, vectors)
    index = lists.build_lists(df)
    blocks = index.blocks(spark).withColumn("n", F.size("keys"))
    assert blocks.agg(F.sum("n")).first()[0] == 1000 and blocks.agg(F.max("n")).first()[0] < 120
    near = got(index.search_exact(asked(df).where("query < 700"), 5, others=True))
    assert all(v == [j for j in range(6) if j != q][:5] for q, v in near.items()) and len(near) == 14, "equal distances go by key"


def test_odd_vectors(spark):
    vs = [(k, [float(x) for x in v]) for k, v in enumerate(even(np.random.default_rng(3), 40, 3))]
    odd = [(100, None), (101, []), (102, [0.0] * 3), (103, [float("nan"), 1.0, 1.0]), (104, [None, 1.0, 1.0]), (105, [1.0]), (106, [1e300] * 3), (None, [1.0, 2.0, 3.0]), (107, [float("inf")] * 3)]
    df = spark.createDataFrame(vs + odd, SCHEMA).withColumns({c: F.lit(1) for c in ("list", "part", "vector", "keys", "query", "n")})
    index = lists.build_lists(df)
    assert index.rows == 42  # with 106 and the null key
    ask = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [0.0] * 3), (4, [1.0])], "query long, vector array<double>")
    found = index.search_exact(ask, 50)
    assert {r["query"] for r in found.select("query").distinct().collect()} == {1} and found.count() == 42
    assert found.where("rank = 1").first()["neighbour"] == 106
    nothing = lists.build_lists(df.limit(0))
    assert nothing.search(ask, 3).collect() == [] and nothing.search_exact(ask, 3).collect() == []
    grown, again = lists.maintain(nothing, df, df)
    assert again and grown.rows == 42


def test_growth(spark):
    vectors = clustered(np.random.default_rng(5), 800, 6)
    df = frame(spark, vectors)
    index = lists.build_lists(df.where("vec_id < 300"))
    assert not index.stale(899) and index.stale(900)
    more, rebuilt = lists.maintain(index, df, df.where("vec_id >= 300"))
    assert not rebuilt and more.rows == 800 and more.generation == 1
    opened = lists.open_lists(spark, more.path, 1)
    assert got(opened.search_exact(asked(df), 7, others=True)) == brute(vectors, range(0, 800, 50), 7, "cosine")
    assert lists.maintain(index, df, df, factor=2)[1]


@pytest.mark.parametrize("rows", [1, 7, 100_000])
def test_largest_inner_products(spark, monkeypatch, rows):
    """Blocks of one vector, of some, and one for all; norms of all sizes, zero and negative scores, ties and no place."""
    dim = 5
    monkeypatch.setattr(lists, "BLOCK_BYTES", 8 * dim * rows)
    r = np.random.default_rng(6)
    n = 60 if rows == 1 else 400
    x = r.normal(size=(n, dim)) * np.exp(r.normal(size=(n, 1)))
    x[3] = x[9] = x[11]
    x[5] = 0
    users = r.normal(size=(30, dim))
    users[4] = 0
    users[7] = -abs(users[7])
    x[20:40] = abs(x[20:40])
    df = lambda m, c: spark.createDataFrame([(k, [float(z) for z in v]) for k, v in enumerate(m)] + [(900, None), (901, [1.0]), (902, [float("nan")] * dim)], f"{c} long, v array<double>")
    got = {}
    for row in lists.top_products(df(users, "user"), df(x, "item"), 6).collect():
        got.setdefault(row["user"], {})[row["rank"]] = (row["item"], row["score"])
    assert sorted(got) == list(range(30))
    for u, found in got.items():
        s = x @ users[u]
        want = sorted(range(n), key=lambda j: (-round(s[j], 10), j))[:6]
        assert [round(found[k + 1][1], 9) for k in range(6)] == [round(s[j], 9) + 0.0 for j in want]
    assert lists.top_products(df(users, "user"), df(x, "item").limit(0), 6).collect() == []
