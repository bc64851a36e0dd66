"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of statistics (lengths, character classes, repetition), transformed towards normal
shapes by logarithms and roots. Every labelled training row adds its vector and outer product to its class's sums, so
the class means and covariances are of all of them, gathered by one small aggregation. Covariances are shrunk towards
the pooled one and towards its diagonal. A score is the logistic function of the difference of the classes'
Mahalanobis log densities plus the log prior odds, divided by a temperature; the Cholesky factors are computed once
and sent with the scoring function.

Defined results: null and empty texts have the vector of an empty text and a score like any other; rows pass through
one for one, repeated or not; labels other than 0 and 1 and labels without a document are ignored, a document labelled
twice counts twice; with labels of one class only every score is that class (1 or 0), with none it is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, tune

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:!?"
_HIGH = bytes(range(128, 256))
_SPACE = b" \t\n\r\x0b\x0c"
#: Everything but marks that prose seldom has.
_PROSE = bytes(sorted({*_LOWER, *_UPPER, *_DIGITS, *_STOPS, *_HIGH, *_SPACE, *b"'\"-()"}))

NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "marks", "distinct", "top_pair", "echo", "lines", "same_lines", "lone_marks", "long_words")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, as NAMES."""
    t = (text or "").encode("utf-8", "surrogatepass")
    n = len(t)
    less = lambda cs: n - len(t.translate(None, cs))
    w = t.split()
    k = len(w)
    rows = t.split(b"\n")
    kinds = len(set(w))
    share = lambda x, of: math.sqrt(x / of) if of else 0.0
    return [
        math.log1p(n),
        math.log1p(k),
        math.log((n + 1) / (k + 1)),
        share(less(_UPPER), n),
        share(less(_DIGITS), n),
        share(less(_STOPS), n),
        share(len(t.translate(None, _PROSE)), n),
        math.log((kinds + 1) / (k + 1)) / math.log(k + 2),
        share(k - len(set(zip(w, w[1:]))) - 1, k) if k > 1 else 0.0,
        share(sum(map(eq, w, w[1:])), k),
        share(len(rows) - 1, k + 1),
        share(len(rows) - len(set(rows)), len(rows)),
        share(sum(map(w.count, (b"|", b"-", b"*", b"#"))), k),
        share(sum(1 for x in w if len(x) > 24), k),
    ]


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) of every whole text, in one pass."""
    tune(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([statistics(x.as_py()) for x in b.column(1)], pa.list_(pa.float64()))], names=[id_col, "x"])

    return src.mapInArrow(run, f"{id_col} long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """means and inverse Cholesky factors by class; offset: log prior odds and log determinants."""

    means: tuple | None
    factors: tuple | None
    offset: float
    temperature: float

    def score(self, x):
        import numpy as np

        x = np.asarray(x, dtype=float)
        if self.means is None:
            return np.full(len(x), self.offset)
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors)]
        z = (0.5 * (far[0] - far[1]) + self.offset) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(batches, d: int):
    """One task's sums by class: rows (label, place, value) of count, vector and outer product."""
    import numpy as np

    total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for b in batches:
        y = np.asarray(b.column(1).to_pylist())
        x = np.asarray(b.column(0).flatten()).reshape(-1, d)
        for c, t in total.items():
            own = x[y == c]
            t += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    for c, t in total.items():
        if t[0]:
            yield pa.record_batch([pa.array([c] * len(t), pa.int32()), pa.array(range(len(t)), pa.int32()), pa.array(t)], names=["label", "place", "value"])


def fit(labelled: DataFrame, shrink: float = 0.1, diagonal: float = 0.05, temperature: float = 2.0) -> Discriminant:
    """The discriminant of a table (x array<double>, label int), from all its rows."""
    import numpy as np

    d = len(NAMES)

    def run(batches):
        yield from _sums(batches, d)

    src = labelled.where("label in (0, 1) and x is not null").select("x", F.col("label").cast("int").alias("label"))
    rows = src.mapInArrow(run, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()  # 2 (1 + d + d^2) numbers
    total = {}
    for r in rows:
        total.setdefault(r["label"], np.zeros(1 + d + d * d))[r["place"]] = r["value"]
    if len(total) < 2:
        return Discriminant(None, None, float(next(iter(total), 0.5)), temperature)
    n = {c: t[0] for c, t in total.items()}
    mean = {c: t[1 : 1 + d] / t[0] for c, t in total.items()}
    own = {c: total[c][1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in total}
    pooled = sum(n[c] * own[c] for c in own) / sum(n.values())
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, half_log = [], []
    for c in (0, 1):
        a = max(shrink, d / (d + n[c]))
        s = (1 - a) * own[c] + a * pooled
        low = np.linalg.cholesky((1 - diagonal) * s + diagonal * floor + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(low))
        half_log.append(np.log(np.diag(low)).sum())
    return Discriminant((mean[0], mean[1]), tuple(factors), float(half_log[0] - half_log[1] + math.log(n[1] / n[0])), temperature)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """(id, held_out, score, predicted) of every document, learnt from labels of documents that are not held out.

    One pass over the texts writes the vectors; labels are joined to vectors, not to texts.
    """
    x, _ = materialize(featurize(docs, id_col, text_col), "vectors")
    y = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("label")).where(f"{id_col} is not null and label in (0, 1)")
    model = fit(x.where(~held_out(id_col)).join(y, id_col), **options)

    def run(batches):
        import numpy as np

        for b in batches:
            v = model.score(np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)) if b.num_rows else []
            yield pa.record_batch([b.column(0), pa.array(v, pa.float64()), pa.array([int(s >= threshold) for s in v], pa.int32())], names=[id_col, "score", "predicted"])

    out = x.mapInArrow(run, f"{id_col} long, score double, predicted int")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with the columns they had; learnt as score_quality."""
    tune(docs.sparkSession)
    y = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("label")).where(f"{id_col} is not null and label in (0, 1)")
    model = fit(featurize(docs.where(~held_out(id_col)), id_col, text_col).join(y, id_col), **options)
    if model.means is None and model.offset == 0.5:
        return docs  # nothing learnt, nothing rejected

    def run(batches):
        for b in batches:
            if b.num_rows:
                good = model.score([statistics(x.as_py()) for x in b.column(text_col)]) >= threshold
                yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
