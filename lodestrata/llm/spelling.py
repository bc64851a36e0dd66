"""Spelling variants by a symmetric-delete join.

1. Tasks count the runs of letters of whole texts in Arrow batches; counts meet by word.
2. Every word emits itself and its distinct single deletions: 64-bit hashes of them, computed for all places of a word at
   once from the hashes of what stands before and after, so a word of a million letters needs no more than its length.
   A deletion comes with the places that give it (a stretch of equal letters).
3. Rows meet by equal keys. Two words of one length differ in exactly one place if places of theirs meet; a word and a
   deletion of another are an insertion. So the join makes a row for a near pair, and none for others but hash
   collisions, and the exact distance is verified. A near pair shares exactly one key, so links are counted once. A key
   holds at most a few letters' worth of words at each place: no group grows with the input.
4. A word's form is its near word of largest count. Roots follow forms by pointer doubling: each round joins what is
   reached so far with itself and is written before the next. Counts at least double at each form, so rounds are few.

``every`` deletes a letter of runs that a hash of id and run picks: the noise that the query is asked to have.

Defined results: null or empty texts have no runs; a null id is the empty string in the hash; every row counts, whether
its id repeats or not; equal counts go to the word that is smaller in code-point order; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, tune
from .words import latin_letters, numbered_words, runs

_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Letters of words that are hashed at a time.
SLICE_LETTERS = 1 << 20


def _count(min_length: int, every: int | None):
    """Counts (word, n) of batches (text, id); of each word that the hash of id and word picks, one letter less."""

    def run(batches):
        import numpy as np

        for t, row, code, words in numbered_words(batches, 0, latin_letters, min_length):
            size = max(1, len(words))
            pair, n = runs(row * size + code)
            row, code, new = pair // size, pair % size, []
            if every:
                begun = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in t.column(1).to_pylist()]
                crc, spelled = zlib.crc32, words.cast(pa.large_binary()).to_pylist()
                h = np.fromiter((crc(spelled[c], begun[r]) for r, c in zip(row.tolist(), code.tolist())), np.int64, len(pair))
                on = h % every == 0
                for c, v, k in zip(code[on], h[on], n[on]):
                    w = spelled[c].decode()
                    at = int(v) % len(w)
                    new.append((w[:at] + w[at + 1 :], int(k)))
                code, n = code[~on], n[~on]
            total = np.zeros(size, np.int64)
            np.add.at(total, code, n)
            kept = np.flatnonzero(total)
            for k in range(0, len(kept), 1 << 16):
                s = kept[k : k + (1 << 16)]
                yield pa.record_batch([words.take(pa.array(s)).cast(pa.string()), pa.array(total[s])], names=["word", "n"])
            if new:
                yield pa.record_batch([pa.array([w for w, _ in new], pa.string()), pa.array([k for _, k in new], pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters, only A-Z lower-cased; every: a letter of each so manieth run of a text is deleted."""
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id"))
    found = d.mapInArrow(_count(min_length, every), "word string, n long").where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mixed(c):
    """Code points as well-spread odd numbers (the finaliser of a common 64-bit generator)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31)) | np.uint64(1)


def deletions(letters):
    """Of a matrix of words of one length (code points): the hash of each word (m), of each word without each letter
    (m x length), and whether a letter begins a stretch of equal ones."""
    import numpy as np

    m, size = letters.shape
    x = _mixed(letters)
    power = np.array([pow(_BASE, k, 1 << 64) for k in range(size + 1)], np.uint64)
    with np.errstate(over="ignore"):
        before = np.zeros((m, size + 1), np.uint64)
        after = np.zeros((m, size + 1), np.uint64)
        np.cumsum(x * power[:size], axis=1, out=before[:, 1:])  # letters weigh by their place from the left
        after[:, :size] = before[:, -1:] - before[:, :size]
        # what follows a deleted letter moves one place to the left: times the inverse of the base
        less = before[:, :size] + after[:, 1:] * np.uint64(pow(_BASE, -1, 1 << 64))
    begins = np.ones((m, size), bool)
    begins[:, 1:] = letters[:, 1:] != letters[:, :-1]
    return before[:, -1], less, begins


KEYS = "key long, lo int, hi int, word string, n long"


def _emit(batches):
    """(key, lo, hi, word, n): the word itself (lo -1), and its distinct deletions with the places lo to hi that give them."""
    import numpy as np

    for b in batches:
        words, n = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            all_of = np.flatnonzero(sizes == size)
            step = max(1, SLICE_LETTERS // int(size))
            for k in range(0, len(all_of), step):
                own = all_of[k : k + step]
                some = words.take(pa.array(own))
                letters = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(own), size)
                whole, less, begins = deletions(letters)
                at, lo = np.nonzero(begins)
                ends = np.append(lo[1:], 0) - 1
                last = np.append(at[1:] != at[:-1], True)
                hi = np.where(last, size - 1, ends)
                rows = np.concatenate([np.arange(len(own)), at])
                key = np.concatenate([whole, less[at, lo]]).view(np.int64)
                lo, hi = (np.concatenate([np.full(len(own), -1), v]).astype(np.int32) for v in (lo, hi))
                for j in range(0, len(rows), 1 << 16):
                    s = slice(j, j + (1 << 16))
                    yield pa.record_batch([pa.array(key[s]), pa.array(lo[s]), pa.array(hi[s]), some.take(pa.array(rows[s])), pa.array(n[own][rows[s]])], names=["key", "lo", "hi", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): all pairs of (word, n) rows that differ by one inserted, deleted or replaced code point."""
    keys = words.mapInArrow(_emit, KEYS)
    other = keys.select("key", *[F.col(c).alias(f"other_{c}") for c in ("lo", "hi", "word", "n")])
    met = ((F.col("lo") < 0) != (F.col("other_lo") < 0)) | ((F.col("lo") >= 0) & (F.col("other_lo") >= 0) & (F.col("lo") <= F.col("other_hi")) & (F.col("other_lo") <= F.col("hi")) & (F.col("word") != F.col("other_word")))
    pairs = keys.join(other.hint("merge"), (keys["key"] == other["key"]) & met)
    return pairs.where(F.levenshtein("word", "other_word", 1) == 1).select("word", F.col("other_word").alias("other"), "other_n")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, times: int = 2, every: int | None = None, id_col: str = "doc_id", text_col: str = "text", max_rounds: int = 64) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word: how many near words it has; the one of largest count, if that is
    at least `times` its own; and the word that forms lead to."""
    tune(docs.sparkSession)
    words, words_at = materialize(word_counts(docs, min_length, min_count, every, id_col, text_col), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("b"))
    form_n = -F.col("b.less")
    ahead = form_n >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ahead, F.col("b.form")).alias("form"), F.when(ahead, form_n).alias("form_n"))
    found = found.withColumns({"root": F.coalesce("form", "word"), "moved": F.col("form").isNotNull()})
    found, at = materialize(found, "forms")
    forget(docs.sparkSession, words_at)
    for _ in range(max_rounds):
        # only rows that moved may move again, and only to what is ahead of a word that moved itself
        if found.where("moved").isEmpty():
            return found.drop("moved")
        ahead = found.where(F.col("form").isNotNull()).select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = found.where("moved").join(ahead, "root", "left").withColumns({"moved": F.col("next").isNotNull(), "root": F.coalesce("next", "root")})
        new, new_at = materialize(found.where(~F.col("moved")).unionByName(step.drop("next")), "forms")
        forget(docs.sparkSession, at)
        found, at = new, new_at
    raise RuntimeError("forms did not end")
