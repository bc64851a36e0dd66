"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters of the lower-cased text give n-grams of one to three, hashed to a fixed number of buckets. A feature is
log(1 + count) times the inverse document frequency of its bucket (over all training documents), vectors scaled to
length one. Weights are trained by follow-the-regularised-leader (proximal, per coordinate) with L1 and L2 penalties,
so most stay zero, and the probabilities are calibrated by one temperature, fitted on a part of the sample that the
weights have not seen.

The weights are fitted on at most about ``sample_docs`` documents, the same number of each language as far as there
are so many, chosen by a hash of the id; document frequencies and predictions cover all documents.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is nothing
to learn from; null labels and null ids are not learnt from; rows pass through one for one.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, tune

BITS = 16
UNDETERMINED = "und"


def counts_of(text: str):
    """Buckets of the text's n-grams and how often each occurs."""
    import numpy as np

    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    mix, shift = np.uint32(2654435761), np.uint32(32 - BITS)
    two = c[:-1] * np.uint32(40503) + c[1:]
    three = two[:-1] * np.uint32(69069) + c[2:]
    h = np.concatenate([(c + np.uint32(1)) * mix >> shift, (two ^ np.uint32(0x5BD1E995)) * mix >> shift, (three ^ np.uint32(0x2C1B3C6D)) * mix >> shift])
    n = np.bincount(h.astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class LanguageModel:
    """langs in order; weights by bucket and language with the inverse document frequency folded in; bias."""

    langs: list
    idf: object
    weights: object
    bias: object
    temperature: float = 1.0

    def logits(self, at, n):
        import numpy as np

        x = np.log1p(n) * self.idf[at]
        return (x / max(float(np.sqrt(x @ x)), 1e-12)) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        z = self.logits(*counts_of(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def ftrl(rows, targets, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 2):
    """Weights (bucket, class) and bias of multinomial logistic regression by proximal follow-the-regularised-leader.

    rows: (buckets, values) of each example; the bias is a feature that is always one."""
    import numpy as np

    z, n = (np.zeros(((1 << BITS) + 1, classes)) for _ in range(2))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for (at, x), y in zip(rows, targets):
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    w = weights(z, n)
    return w[:-1], w[-1]


def _frequencies(batches):
    """One task's document frequencies: rows (bucket, docs), and the number of documents as bucket -1."""
    import numpy as np

    df, docs = np.zeros(1 << BITS, dtype=np.int64), 0
    for b in batches:
        for x in b.column(0):
            df[counts_of(x.as_py())[0]] += 1
        docs += b.num_rows
    if docs:
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], docs))], names=["bucket", "docs"])


def train(docs: DataFrame, sample_docs: int = 4_000, seed: int = 11, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **options) -> LanguageModel:
    """A calibrated model of the labelled rows of docs."""
    import numpy as np

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not n:
        return LanguageModel([], None, None, None)
    langs = sorted(n)

    def frequencies(batches):
        yield from _frequencies(batches)

    got = rows.select(F.col(text_col).cast("string")).mapInArrow(frequencies, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()  # a row per bucket
    df = np.zeros(1 << BITS)
    own = got[got.bucket >= 0]
    df[own.bucket.to_numpy()] = own.docs.to_numpy()
    total = int(got[got.bucket < 0].docs.sum())
    idf = np.log((1 + total) / (1 + df)) + 1

    quota = max(1, sample_docs // len(langs))
    part = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, float(min(1.0, quota / n[k])))]), F.col(lang_col).cast("string"))
    order = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30))

    def features(batches):
        for b in batches:
            both = [counts_of(x.as_py()) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x[0].astype(np.uint16).tobytes() for x in both], pa.binary()), pa.array([x[1].astype(np.uint32).tobytes() for x in both], pa.binary())], names=["o", "lang", "at", "n"])

    few = rows.where(order / F.lit(float(1 << 30)) < part).select(order.alias("o"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    few = few.mapInArrow(features, "o long, lang string, at binary, n binary").toArrow().to_pylist()
    few.sort(key=lambda r: (r["o"], r["lang"], r["at"], r["n"]))
    model = LanguageModel(langs, idf, None, None)
    xs, ys = [], []
    for r in few:
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        x = np.log1p(np.frombuffer(r["n"], np.uint32)) * idf[at]
        xs.append((at, x / max(float(np.sqrt(x @ x)), 1e-12)))
        ys.append(langs.index(r["lang"]))
    kept = [k for k in range(len(xs)) if k % 5 == 4] if len(xs) >= 20 else []
    fit = [k for k in range(len(xs)) if len(xs) < 20 or k % 5 != 4]
    w, bias = ftrl([xs[k] for k in fit], [ys[k] for k in fit], len(langs), **options)
    model.weights, model.bias = w, bias
    if kept:
        z = np.array([xs[k][1] @ w[xs[k][0]] + bias for k in kept])
        y = np.array([ys[k] for k in kept])

        def loss(t: float) -> float:
            s = z / t
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.1, 10, 81), key=loss)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    spark = docs.sparkSession
    tune(spark)
    if model.weights is not None:
        import numpy as np

        model = LanguageModel(model.langs, model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias, float(model.temperature))
    sent = spark.sparkContext.broadcast(model)  # buckets times languages
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        m = sent.value
        for b in batches:
            out = [m.predict(x.as_py()) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[id_col, "lang_pred", "score"])

    return src.mapInArrow(run, f"{id_col} long, lang_pred string, score double")


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id, held_out, lang_pred, score): learnt from rows that are not held out, predicted for all."""
    tune(docs.sparkSession)
    model = train(docs.where(~held_out(id_col)), text_col=text_col, lang_col=lang_col, id_col=id_col, **options)
    return identify(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
