"""Substring dedup with suffix automata of reference shards.

A window is a run of ``window`` words; a word is removed if a window over it also starts in a document with a smaller
id. Documents are streamed through suffix automata of earlier documents' text; at each word the matching statistic
(the longest suffix that the shard holds) and the first document of the state of its last ``window`` words tell
whether the window is removed.

Sending every automaton to every document costs shards times documents, so text is routed instead, and only the text
that can match:

1. Every window has an anchor, the least hash of the word 5-grams in it. Equal windows have equal anchors. Anchors
   are counted over all documents; a window whose anchor occurs once matches nothing.
2. Anchors that occur again are marked in a bit table of at most ``MAX_BITS`` bits, which is what is broadcast. When
   it fills up, more windows are looked at than need be; no match is lost.
3. The stretch of windows around a marked anchor goes to the shard of its anchor, so equal windows meet. A shard takes
   its stretches in order of document: each is first streamed through the automaton, then added, unless the automaton
   holds all of it already. A shard's automaton is bounded by its number of different stretches.
4. Windows of anchors that very many documents have go by the window itself, first salted: each salted part removes
   what it can, and only the first document's windows of each part are looked at once more together.

Words are compared by 48 bits of a 64-bit hash of their bytes.

Defined results: null or empty texts have no words; texts shorter than a window lose nothing; rows with one id never
remove words from each other, whether they differ or not; a null id neither removes nor loses words; other columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, tune

MAX_BITS = 1 << 27
#: Words in an anchor.
GRAM = 5
#: An anchor with more occurrences goes by single windows.
HOT = 2_000
SALTS = 64
SHARD_STRETCHES = 8_192
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20
WORD_BYTES = 6

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list = []


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2^64."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        with np.errstate(over="ignore"):
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(texts: list[bytes]):
    """(hashes of all words, text number of each word) of texts laid end to end."""
    import numpy as np

    d = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(d):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.cumsum([0, *map(len, texts)])
    word = (d > 32) | (d < 9) | ((d > 13) & (d < 32))
    cut = np.zeros(len(d) + 1, bool)
    cut[edge] = True
    begins = np.flatnonzero(word & (cut[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (cut[1:] | np.concatenate([~word[1:], [True]]))) + 1
    up, down = _powers(len(d))
    sums = np.zeros(len(d) + 1, np.uint64)
    np.cumsum((d.astype(np.uint64) + np.uint64(1)) * up[: len(d)], out=sums[1:])
    return _mix((sums[ends] - sums[begins]) * down[begins]), np.searchsorted(edge, begins, side="right") - 1


def _rolled(h, n: int, seed: int):
    """Hashes of all runs of n words."""
    import numpy as np

    m = [np.uint64(pow(0xD6E8FEB86659FD93, seed + j, 1 << 64)) for j in range(n)]
    out = h[: len(h) - n + 1] * m[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * m[j]
    return _mix(out)


def _windows(texts: list[bytes], window: int):
    """(word hashes, text of each word, starts of windows, anchors of these)."""
    import numpy as np

    h, of = hash_words(texts)
    n = len(h) - window + 1
    if n <= 0:
        return h, of, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = min(GRAM, window)
    g = _rolled(h, k, 1)
    low = g[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(low, g[j : n + j], out=low)
    at = np.flatnonzero(of[:n] == of[window - 1 :])
    return h, of, at, low[at]


def _slices(batch):
    """Rows of a batch as (numbers, texts), of about SLICE_BYTES each."""
    rows, texts, size = [], [], 0
    for k, x in enumerate(batch.column(1)):
        t = x.as_py()
        if not t:
            continue
        t = t.encode("utf-8", "surrogatepass")
        if texts and size + len(t) > SLICE_BYTES:
            yield rows, texts
            rows, texts, size = [], [], 0
        rows.append(k)
        texts.append(t)
        size += len(t)
    if texts:
        yield rows, texts


def _anchors(batches, window: int):
    import numpy as np

    for b in batches:
        for _, texts in _slices(b):
            _, of, at, low = _windows(texts, window)
            if len(at):
                new = np.concatenate([[True], (low[1:] != low[:-1]) | (of[at[1:]] != of[at[:-1]])])
                yield pa.record_batch([pa.array(low[new].view(np.int64))], names=["anchor"])


def _has(bits, h):
    import numpy as np

    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def row_key(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _stretches(batches, window: int, again, hot):
    """Rows (key, doc, row, start, single, words): what may match, by anchor or, of hot anchors, by window."""
    import numpy as np

    for b in batches:
        ids = b.column(0).to_pylist()
        for rows, texts in _slices(b):
            h, of, at, low = _windows(texts, window)
            seen = _has(again, low)
            at, low = at[seen], low[seen]
            if not len(at):
                continue
            zero = np.searchsorted(of, np.arange(len(texts)))  # each text's first word
            mine = of[at]
            single = _has(hot, low)
            first = np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1])]) | single
            begin = np.flatnonzero(first)
            last = np.concatenate([begin[1:], [len(at)]]) - 1
            key = low[begin].copy()
            one = single[begin]
            key[one] = _rolled(h, window, 40)[at[begin[one]]]
            a, z, t = at[begin], at[last] + window, mine[begin]
            packed = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
            keys = [row_key(x) for x in texts]
            words = [packed[i:j] for i, j in zip((a * WORD_BYTES).tolist(), (z * WORD_BYTES).tolist())]
            t_ = t.tolist()
            yield pa.record_batch([
                pa.array(key.view(np.int64)), pa.array([ids[rows[k]] for k in t_], pa.int64()), pa.array([keys[k] for k in t_], pa.int64()),
                pa.array((a - zero[t]).astype(np.int32)), pa.array(one), pa.array(words, pa.binary()),
            ], names=["key", "doc", "row", "start", "single", "words"])


class SuffixAutomaton:
    """Of the strings added so far, in ascending order of document; each state knows its first document."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [0]

    def _state(self, edges: dict, link: int, length: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of the string that leads to p, then c; q where its longest string is longer than that."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, symbols, doc: int) -> None:
        nxt, at = self.next, 0
        for c in symbols:
            q = nxt[at].get(c)
            if q is not None:
                at = self._split(at, c, q)
                continue
            new, p = self._state({}, 0, self.length[at] + 1, doc), at
            while p >= 0 and (q := nxt[p].get(c)) is None:
                nxt[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, q)
            at = new

    def match(self, symbols, doc: int, window: int) -> tuple[list[int], bool]:
        """Starts of the windows that an earlier document holds; whether all of the string is here."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        s = n = 0
        out = []
        for k, c in enumerate(symbols):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(c)
            if t is None:
                n = 0
                continue
            s, n = t, n + 1
            if n >= window:
                u = s
                while length[link[u]] >= window:
                    u = link[u]
                if first[u] < doc:
                    out.append(k - window + 1)
        return out, n == len(symbols)


def _shards(batches, window: int, salted: bool):
    """Streams each shard's stretches, in order of shard and document, through the shard's automaton.

    Rows (doc, row, a, z, open, key, start, words): words [a, z) are removed; open rows are single windows of a salted
    part that no earlier document of that part has."""
    tree, shard = None, None
    for b in batches:
        out = []
        for s, key, doc, row, start, single, words in zip(*(c.to_pylist() for c in b.columns)):
            if s != shard:
                tree, shard = SuffixAutomaton(), s
            symbols = [words[k : k + WORD_BYTES] for k in range(0, len(words), WORD_BYTES)]
            hits, whole = tree.match(symbols, doc, window)
            if not whole:
                tree.add(symbols, doc)
            a = z = None
            for k in hits:
                if z is not None and start + k <= z:
                    z = start + k + window
                else:
                    if z is not None:
                        out.append((doc, row, a, z, False, None, None, None))
                    a, z = start + k, start + k + window
            if z is not None:
                out.append((doc, row, a, z, False, None, None, None))
            elif salted and single:
                out.append((doc, row, None, None, True, key, start, words))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
        cols = zip(*out) if out else [()] * len(types)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc", "row", "a", "z", "open", "key", "start", "words"])


def _cut(batches):
    """Kept text of each row, with how many words it has and loses."""
    for b in batches:
        out = ([], [], [])
        for x, spans in zip(b.column(1), b.column(2).to_pylist()):
            w = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
            n = len(w)
            if spans:
                keep, at = [], 0
                for s in sorted(spans, key=lambda s: (s["a"], s["z"])):
                    if s["a"] > at:
                        keep += w[at : s["a"]]
                    at = max(at, s["z"])
                w = keep + w[at:]
            for c, v in zip(out, (n, n - len(w), b" ".join(w).decode("utf-8", "surrogatepass"))):
                c.append(v)
        yield pa.record_batch([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["id", "n_words", "n_removed", "kept"])


def repeated_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, hot: int = HOT) -> tuple[DataFrame, list[str]]:
    """(doc, row, spans): word ranges [a, z) to remove from the row of that id and text hash; paths of tables it reads."""
    spark = docs.sparkSession
    tune(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")

    def anchors(batches):
        yield from _anchors(batches, window)

    counts = src.mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    counts, counts_at = materialize(counts, "anchors")
    total = counts.agg(F.count("*").alias("k"), F.sum(F.when(F.col("n") <= hot, F.col("n"))).alias("few"), F.sum(F.when(F.col("n") > hot, F.col("n"))).alias("many")).first()
    bits = 1 << 16
    while bits < min(max_bits, 32 * total["k"]):
        bits *= 2

    def table(rows: DataFrame):
        import numpy as np

        at = F.col("anchor").bitwiseAND(F.lit(bits - 1))
        got = rows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(anchor & 63 as int))")).alias("b")).toArrow()  # at most bits / 64 rows
        out = np.zeros(bits // 64, np.uint64)
        out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
        return out

    sent = spark.sparkContext.broadcast((table(counts), table(counts.where(F.col("n") > hot))))

    def stretches(batches):
        yield from _stretches(batches, window, *sent.value)

    shards = max(1, -(-((total["few"] or 0) + GRAM * (total["many"] or 0)) // SHARD_STRETCHES))
    parts = src.mapInArrow(stretches, "key long, doc long, row long, start int, single boolean, words binary")
    salt = F.when(F.col("single"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(0))
    cols = ["shard", "key", "doc", "row", "start", "single", "words"]
    out_schema = "doc long, row long, a int, z int, open boolean, key long, start int, words binary"

    def dealt(rows: DataFrame, shard, salted: bool) -> DataFrame:
        def run(batches):
            yield from _shards(batches, window, salted)

        rows = rows.withColumn("shard", shard).select(*cols).repartition("shard").sortWithinPartitions("shard", "doc", "row", "start")
        return rows.mapInArrow(run, out_schema)

    found, found_at = materialize(dealt(parts, F.pmod(F.xxhash64("key", salt), F.lit(shards)), True), "matches")
    late = dealt(found.where("open").withColumn("single", F.lit(True)), F.pmod(F.xxhash64("key"), F.lit(shards)), False)
    spans = found.where("not open").select("doc", "row", "a", "z").unionByName(late.select("doc", "row", "a", "z"))
    forget(spark, counts_at)
    return spans.groupBy("doc", "row").agg(F.collect_set(F.struct("a", "z")).alias("spans")), [found_at]


def dedup_substrings(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_removed, kept): every text without the words of windows that a smaller id has; kept words are
    joined by one space."""
    spans, _ = repeated_spans(docs, window, id_col, text_col, **options)

    def keyed(batches):
        for b in batches:
            keys = [None if (t := x.as_py()) is None else row_key(t.encode("utf-8", "surrogatepass")) for x in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.int64())], names=["id", "text", "row"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(keyed, "id long, text string, row long")
    both = src.join(spans.withColumnRenamed("row", "_row"), (F.col("id") == F.col("doc")) & (F.col("row") == F.col("_row")), "left").select("id", "text", "spans")

    def cut(batches):
        yield from _cut(batches)

    return both.mapInArrow(cut, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
