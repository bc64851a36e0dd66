"""The stored index against brute force; what its searches read and leave out."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import postings, search


def brute(texts, question, k1=1.2, b=0.75):
    docs = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in texts if t is not None}
    mean = sum(map(len, docs.values())) / max(1, len(docs))
    out = Counter()
    for w in set(re.findall("[a-z0-9]+", question.lower())):
        tf = {i: t.count(w) for i, t in docs.items() if w in t}
        idf = math.log(1 + (len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))
        for i, f in tf.items():
            out[i] += idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len(docs[i]) / mean))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    out = [(k, " ".join(r.choices(vocabulary, weights, k=r.choice([3, 9, 40, 160])))) for k in range(900)]
    return [*out, (900, None), (901, ""), (902, "É w0-W1_w0 ... über"), (903, "only here"), *[(910 + k, "w7 w8 w9") for k in range(40)]]


@pytest.fixture(scope="module")
def index(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "term", "n", "block", "tf")})
    return postings.build_index(df, buckets=8, block=16)


@pytest.mark.parametrize("question", ["w0", "w0 w1 w59", "w7 w8 w9 nowhere", "only here w2", "nowhere", "", "w1 w1 W1"])
def test_search(spark, texts, index, question):
    want = brute(texts, question)
    for k in (1, 10, 2000):
        got = [(r["id"], r["score"]) for r in index.search(spark, question, k, lead=2).collect()]
        best = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        assert [i for i, _ in got] == [i for i, _ in best]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, best))
    assert {r["id"]: round(r["score"], 9) for r in index.scores(spark, question).collect()} == {i: round(s, 9) for i, s in want.items()}


def test_bounds_hold_and_leave_blocks_out(spark, texts, index):
    question = "w40 w59"
    of = {r["id"]: r["block"] for r in spark.read.parquet(f"{index.path}/postings").select("id", "block").distinct().collect()}
    bound = {r["block"]: r["bound"] for r in index.bounds(spark, question).collect()}
    want = brute(texts, question)
    assert all(s <= bound[of[i]] + 1e-9 for i, s in want.items())
    tenth = sorted(want.values())[-10]
    assert sum(b >= tenth for b in bound.values()) < len(set(of.values())) / 2


def test_match_all(spark, texts, index):
    docs = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t in texts if t is not None}
    for question in ("w0 w30", "only here", "w0 nowhere"):
        assert {r["id"] for r in index.match_all(spark, question).collect()} == {i for i, t in docs.items() if set(question.split()) <= t}


def test_only_the_terms_partitions_are_read(spark, index):
    p, _ = index.postings(spark, "w3 w4")
    plan = p._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in scan.split("PushedFilters: [")[1]
    assert "text" not in scan


def test_opened_again_and_empty(spark, texts, index):
    again = postings.open_index(spark, index.path)
    assert again == index
    df = spark.createDataFrame(texts, "doc_id long, text string")
    same = {(r["id"], round(r["score"], 9)) for r in search.bm25(df, "w5 w6").collect()}
    assert {(r["id"], round(r["score"], 9)) for r in again.scores(spark, "w5 w6").collect()} == same
    none = postings.build_index(df.limit(0))
    assert none.search(spark, "w1", 3).collect() == [] and none.docs == 0


def test_rows_of_one_id_add_up(spark):
    index = postings.build_index(spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "b")], "doc_id long, text string"))
    got = {r["id"]: r["score"] for r in index.scores(spark, "a").collect()}
    one = math.log(1 + 1.5 / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (5 / 3)))
    assert list(got) == [1] and abs(got[1] - 2 * one) < 1e-9
