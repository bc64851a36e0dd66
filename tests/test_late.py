"""Late interaction against brute force: long texts in blocks, missing and odd token vectors, ties."""

import numpy as np

from lodestrata.operators import late


def test_max_sim(spark, monkeypatch):
    monkeypatch.setattr(late, "BLOCK_TOKENS", 4)
    r = np.random.default_rng(1)
    texts = {d: r.normal(size=(n, 3)) for d, n in ((1, 11), (2, 4), (3, 1), (4, 9))}
    asked = {7: r.normal(size=(5, 3)), 8: r.normal(size=(2, 3))}
    rows = lambda m: [(k, t, [float(x) for x in v]) for k, vs in m.items() for t, v in enumerate(vs)]
    docs = spark.createDataFrame([*rows(texts), (1, 50, [0.0] * 3), (2, 51, None), (3, 52, [1.0]), (6, 0, [float("nan")] * 3)], "doc long, token long, v array<double>")
    qs = spark.createDataFrame(rows(asked), "query long, token long, v array<double>")
    pairs = [(q, d, 0.5 if d < 3 else 0.25) for q in (7, 8, 9) for d in (1, 2, 3, 4, 5, 6)]
    cand = spark.createDataFrame(pairs, "query long, doc long, similarity double")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, d): float((unit(asked[q]) @ unit(texts[d]).T).max(1).sum()) if q in asked and d in texts else 0.0 for q, d, _ in pairs}
    got = late.max_sim(cand, qs, docs, 3).collect()
    assert {(x["query"], x["doc"]): round(x["similarity"], 9) for x in got} == {k: round(v, 9) for k, v in want.items()}
    assert {(x["query"], x["doc"]): x["original_score"] for x in got} == {(q, d): s for q, d, s in pairs}
    assert [x["doc"] for x in sorted(got, key=lambda x: x["rank"]) if x["query"] == 9] == [1, 2, 3, 4, 5, 6], "without scores the search's order stays"
    best = late.max_sim(cand, qs, docs, 3, k=1).collect()
    assert {x["query"]: x["doc"] for x in best if x["query"] != 9} == {q: max((d for d in range(1, 7)), key=lambda d: (round(want[q, d], 9), -d)) for q in asked}
    assert late.max_sim(cand.limit(0), qs, docs, 3).collect() == []
