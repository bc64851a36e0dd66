"""Windows over whole tables and exact percentiles against pandas, and their plans."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata import catalog
from lodestrata.operators.ordered import GlobalOrder, exact_percentiles, select_ranks


@pytest.fixture(scope="module")
def values():
    r = random.Random(2)
    # a third of all rows share one value, and nulls are peers as well
    return [(k, None if k % 11 == 0 else 7 if k % 3 == 0 else r.randrange(40), r.random() if k % 5 else None) for k in range(1200)]


@pytest.fixture(scope="module")
def rows(spark, values):
    return spark.createDataFrame(values, "id long, v long, x double").repartition(7)


@pytest.fixture(scope="module")
def frame(values):
    f = pd.DataFrame(values, columns=["id", "v", "x"])
    f["v"] = f["v"].astype("Int64")
    return f


@pytest.mark.parametrize("falling", [False, True])
def test_ranks(rows, frame, falling):
    got = GlobalOrder(rows, ["-v" if falling else "v", "id"], keys=1).ranked("rank", "dense", "percent", "cumulative").toPandas().set_index("id").sort_index()
    v = frame.set_index("id")["v"].fillna(-1)
    v = -v if falling else v
    assert (got["rank"] == v.rank(method="min")).all() and (got["dense"] == v.rank(method="dense")).all()
    assert (abs(got["percent"] - (v.rank(method="min") - 1) / (len(v) - 1)) < 1e-12).all()
    assert (abs(got["cumulative"] - v.rank(method="max") / len(v)) < 1e-12).all()


def test_one_value_fills_all_parts(spark):
    got = GlobalOrder(spark.range(500).withColumn("v", F.lit(1)), ["v"]).ranked("rank", "dense", cumulative="c")
    assert {tuple(r)[2:] for r in got.collect()} == {(1, 1, 1.0)}


@pytest.mark.parametrize("n", [1, 7, 100, 1199, 1200, 5000])
def test_tiles(rows, n):
    got = GlobalOrder(rows, ["id"]).tiles(n).orderBy("id").toPandas()["tile"].tolist()
    small, large = divmod(1200, n)
    assert got == [t + 1 for t in range(min(n, 1200)) for _ in range(small + (t < large))]


def test_running_and_frames(rows, frame):
    f = frame.sort_values("id").set_index("id")
    order = GlobalOrder(rows, ["id"])
    got = order.running(s="v").toPandas().set_index("id").sort_index()
    want = f["v"].fillna(0).cumsum()
    assert pd.isna(got["s"][0]) and (got["s"][1:] == want[1:].astype(float)).all()
    got = order.framed(3, 2, back=lambda w, o: F.lag("id", 3).over(o), total=lambda w: F.sum("x").over(w)).toPandas().set_index("id").sort_index()
    x = f["x"].tolist()
    for k in range(1200):
        seen = [v for v in x[max(0, k - 3) : k + 3] if v is not None and not math.isnan(v)]
        assert (pd.isna(got["back"][k]) and k < 3) or got["back"][k] == k - 3
        assert abs(got["total"][k] - sum(seen)) < 1e-9


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "v long, id long")
    for df in (GlobalOrder(none, ["v"]).numbered(), GlobalOrder(none, ["v"]).tiles(3), GlobalOrder(none, ["v"]).ranked(percent="p"), GlobalOrder(none, ["v"]).running(s="v"), GlobalOrder(none, ["v"]).framed(1, 1, a=lambda w: F.sum("v").over(w))):
        assert df.collect() == []
    one = spark.createDataFrame([(None, 5)], "v long, id long")
    assert [tuple(r) for r in GlobalOrder(one, ["v"]).ranked(percent="p").collect()] == [(None, 5, 1, 0.0)]


#: Orders that no even grid of cells takes apart at once.
HARD = [
    [float(k) for k in range(300)],
    [2.0 ** (k % 600 - 300) for k in range(900)],
    [-(2.0 ** (k % 900 - 600)) for k in range(700)],
    [(-1) ** k * 1.5**k for k in range(-200, 200)] + [0.0] * 30 + [-0.0],
    [float("inf"), float("-inf"), 1e308, -1e308, 5e-324, 1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 9,
    [3.25] * 50,
    [1.0],
]


@pytest.mark.parametrize("leaf,sent", [(4096, 50_000), (3, 0)])
def test_exact_ranks(spark, monkeypatch, leaf, sent):
    from lodestrata.operators import ordered

    monkeypatch.setattr(ordered, "LEAF_ROWS", leaf)
    monkeypatch.setattr(ordered, "SENT_RANKS", sent)
    rows = [(g if g else None, v) for g, vs in enumerate(HARD) for v in vs] + [(1, None), (1, float("nan")), (99, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r["g"], r["rank"]): r["value"] for r in select_ranks(df, ["g"], "v", lambda n: F.array(F.lit(1), F.lit(2), F.expr("n div 2"), F.col("n"))).collect()}
    for g, vs in enumerate(HARD):
        s = sorted(vs)
        assert {k: v for (h, k), v in got.items() if h == (g or None)} == {k: s[k - 1] for k in {1, 2, len(s) // 2, len(s)} if 1 <= k <= len(s)}
    assert all(g != 99 for g, _ in got)


@pytest.mark.parametrize("method,q", [("exclusive", 0.95), ("inclusive", 0.5), ("exclusive", 0.01), ("inclusive", 1.0), ("inclusive", 0.0)])
def test_percentiles(spark, method, q):
    rows = [("a", float(k * k % 977)) for k in range(500)] + [("b", 2.0), ("b", 5.0)]
    got = {r["g"]: r["percentile"] for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", q, method).collect()}
    for g in ("a", "b"):
        s = sorted(v for h, v in rows if h == g)
        at = min(max((len(s) + 1) * q if method == "exclusive" else (len(s) - 1) * q + 1, 1), len(s))
        k = int(at)
        assert abs(got[g] - (s[k - 1] + (at - k) * (s[min(k, len(s) - 1)] - s[k - 1]))) < 1e-9


@pytest.mark.parametrize("name", ["ch18_ntile", "w_percent_rank", "w_relevance_rank", "rw_set_window_fields", "ord_ntile", "ord_ranks", "ord_running", "ord_frames"])
def test_no_task_sees_the_whole_table(spark, sf_dir, name):
    """The only exchanges to one partition are over the rows that describe parts (their first column is _part)."""
    df = catalog.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    for k, line in enumerate(plan):
        if "SinglePartition" in line:
            assert "functions=[" in plan[k + 1] or "HashAggregate" in "".join(plan[k + 1 : k + 3]) or "_part" in plan[k + 1], "\n".join(plan[k : k + 3])
