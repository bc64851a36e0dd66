"""Source divergence audit by a round-robin tournament of term vectors.

Each language's sources are compared with each other and with the language as a whole, over the terms that at least
``min_docs`` of its documents have.

1. Tasks count terms by (lang, source), some Arrow batches at a time, and emit partial counts.
2. Counts meet by (lang, term); terms in fewer documents go. What is left is written once.
3. Terms of a language are dealt to slices of about ``SLICE_ROWS`` counts, and its sources to seats of a few sources. A
   task packs a slice: one compressed block of counts for each seat. While it has the terms at hand, a heap of each
   source ranks the slice's terms against the language, so only the best of each slice travel.
4. The blocks stay where they are, partitioned by (lang, slice, seat). In each round of the tournament every seat meets
   one other: the blocks of the higher seats travel to the lower ones, and a meeting evaluates both directions of each
   pair of sources. Seats play themselves at home. Sums over slices are sums over terms, so nothing larger than a
   slice's block is ever held, and each round's sums are written before the next.

p = 1 + floor(SCALE * (count + 1) / (N + V)); the divergence of p from q is the sum of floor((p - q)^2 / q). Counts are
whole numbers and so is all else: terms that neither source has are counted, not visited.

Defined results: null text, lang or source is the empty string; every row is a document, whether its id repeats or not;
a source without terms has N = 0 and p = 1 + floor(SCALE / V); a language without kept terms has pairs of value 0 and
no terms; equal values rank by item in UTF-8 order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, new_path, tune
from .words import ascii_letters, numbered_words, runs

SCALE = 1_000_000_000
#: Counts in a slice, and sources in a seat where that gives no more than MAX_SEATS of them.
SLICE_ROWS = 1 << 17
SEAT_SOURCES = 4
MAX_SEATS = 32
#: Cells of a matrix that a meeting holds.
HELD_CELLS = 1 << 21


def _count(batches):
    """Counts (lang, source, term, n, d) of each HELD_BYTES of text: occurrences and rows of each term."""
    import numpy as np

    for t, row, code, words in numbered_words(batches, 2, ascii_letters):
        keys = [pc.dictionary_encode(t.column(c).combine_chunks()) for c in range(2)]
        lang, source = (k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys)
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
        size = max(1, len(words))
        key, n = runs(group[row] * size + code)
        pair, _ = runs(row * size + code)
        _, d = runs(group[pair // size] * size + pair % size)
        for k in range(0, len(key), 1 << 16):
            s = slice(k, k + (1 << 16))
            g, term = key[s] // size, key[s] % size
            columns = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), words.take(pa.array(term)).cast(pa.string()), pa.array(n[s].astype(np.int64)), pa.array(d[s].astype(np.int64))]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n", "d"])


def source_counts(docs: DataFrame, min_docs: int, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, source, n, total, first) of terms that at least min_docs rows of the language have; total is the
    language's count, first marks one row of each term."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).cast("string").alias("text"))

    parts = d.mapInArrow(_count, "lang string, source string, term string, n long, d long").repartition("lang", "term")
    w = Window.partitionBy("lang", "term")
    sums = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    sums = sums.withColumns({"first": F.row_number().over(w.orderBy("source")) == 1, "total": F.sum("n").over(w), "docs": F.sum("d").over(w)})
    return sums.where(F.col("docs") >= min_docs).select("lang", "term", "source", "n", "total", "first")


def shares(n, whole, kept):
    """1 + floor(SCALE * (n + 1) / (whole + kept)) as exact whole numbers."""
    import numpy as np

    n = np.asarray(n)
    if len(n) and int(n.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(x) + 1) // (whole + kept) for x in n], np.int64)
    return 1 + SCALE * (n.astype(np.int64) + 1) // (whole + kept)


def _pack(at, n) -> bytes:
    import numpy as np

    return pa.Codec("zstd").compress(np.concatenate([at.astype("<i8"), n.astype("<i8")]).tobytes(), asbytes=True)


def _unpack(size: int, block: bytes):
    import numpy as np

    x = np.frombuffer(pa.Codec("zstd").decompress(block, decompressed_size=16 * size, asbytes=True), "<i8")
    return x[:size], x[size:]


PACKED = "lang string, slice long, seat long, terms long, kept long, sources array<string>, sizes array<long>, counts array<long>, block binary, best array<struct<source:string,item:string,value:long>>"


def pack_slice(t: pa.Table, top: int) -> pa.Table:
    """A slice's rows (lang, slice, seat, source, size, whole, kept, term, n, total), those without a term naming a source,
    as a row for each seat: its sources with their sizes, the places and counts of their terms, and the best terms."""
    import numpy as np

    lang, piece, kept, whole = (t[c][0].as_py() for c in ("lang", "slice", "kept", "whole"))
    real = pc.is_valid(t["term"])
    names = t.filter(pc.invert(real)).sort_by([("seat", "ascending"), ("source", "ascending")])
    who = {s: (int(k), int(n)) for s, k, n in zip(names["source"].to_pylist(), names["seat"].to_pylist(), names["size"].to_pylist())}
    rows = t.filter(real).combine_chunks()
    term = pc.dictionary_encode(rows["term"].combine_chunks())
    words = [w.encode() for w in term.dictionary.to_pylist()]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    code = term.indices.to_numpy(zero_copy_only=False)
    n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
    source = pc.dictionary_encode(rows["source"].combine_chunks())
    known = {s: k for k, s in enumerate(source.dictionary.to_pylist())}
    order = np.lexsort((place[code] if len(code) else code, source.indices.to_numpy(zero_copy_only=False)))
    own = source.indices.to_numpy(zero_copy_only=False)[order]
    q = shares(total, whole, kept) if kept else n
    seats: dict[int, list] = {}
    for s, (seat, size) in who.items():
        k = known.get(s)
        at = order[slice(*np.searchsorted(own, [k, k + 1]))] if k is not None else order[:0]
        p = shares(n[at], size, kept) if len(at) else n[at]
        f = np.where(p > q[at], (p - q[at]) ** 2 // q[at], -1) if len(at) else p
        on = np.flatnonzero(p > q[at]) if len(at) else at
        if len(on) > top:  # those below the value of the last place can't be ranked
            on = on[f[on] >= np.partition(f[on], len(on) - top)[len(on) - top]]
        best = heapq.nsmallest(top, ((-int(f[j]), words[code[at[j]]]) for j in on))
        seats.setdefault(seat, []).append((s, size, place[code[at]] if len(at) else at, n[at], [{"source": s, "item": w.decode(), "value": -v} for v, w in best]))
    out = []
    for seat, g in seats.items():
        block = _pack(np.concatenate([x[2] for x in g]), np.concatenate([x[3] for x in g]))
        out.append({"lang": lang, "slice": piece, "seat": seat, "terms": len(words), "kept": kept, "sources": [x[0] for x in g], "sizes": [x[1] for x in g], "counts": [len(x[2]) for x in g], "block": block, "best": [b for x in g for b in x[4]]})
    return pa.Table.from_pylist(out, schema=PACKED_ARROW)


PACKED_ARROW = pa.schema([("lang", pa.string()), ("slice", pa.int64()), ("seat", pa.int64()), ("terms", pa.int64()), ("kept", pa.int64()), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("block", pa.binary()), ("best", pa.list_(pa.struct([("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])))])


def meet(a: dict, b: dict | None):
    """(source, item, value) of the pairs of two seats' sources (b: None is a seat at home), in both directions."""
    import numpy as np

    def sides(x):
        at, n = _unpack(sum(x["counts"]), x["block"])
        ends = np.cumsum([0, *x["counts"]])
        return [(s, size, at[i:j], n[i:j]) for s, size, i, j in zip(x["sources"], x["sizes"], ends, ends[1:])]

    terms, kept = a["terms"], a["kept"]
    left = sides(a)
    right = left if b is None else sides(b)
    out: dict = {(x[0], y[0]): 0 for x in left for y in right if x is not y}
    out |= {(y, x): 0 for x, y in out}
    if terms:
        every = np.unique(np.concatenate([x[2] for x in left + ([] if b is None else right)]))
        width = max(1, HELD_CELLS // (len(left) + len(right)))

        def grid(side, cols):
            p = np.empty((len(side), len(cols)), np.int64)
            for k, (_, size, at, n) in enumerate(side):
                i, j = np.searchsorted(at, [cols[0], cols[-1] + 1])
                p[k] = shares(np.zeros(1, np.int64), size, kept)[0]
                p[k, np.searchsorted(cols, at[i:j])] = shares(n[i:j], size, kept)
            return p

        rest = terms - len(every)  # terms that none of them has
        none = [[int(shares(np.zeros(1, np.int64), x[1], kept)[0]) for x in side] for side in (left, right)]
        for lo in range(0, len(every), width):
            cols = every[lo : lo + width]
            ps, qs = grid(left, cols), grid(right, cols)
            for i, x in enumerate(left):
                for j in range(i + 1 if b is None else 0, len(right)):
                    square = (ps[i] - qs[j]) ** 2
                    out[x[0], right[j][0]] += int((square // qs[j]).sum())
                    out[right[j][0], x[0]] += int((square // ps[i]).sum())
        for i, x in enumerate(left):
            for j in range(i + 1 if b is None else 0, len(right)):
                p, q = none[0][i], none[1][j]
                out[x[0], right[j][0]] += rest * ((p - q) ** 2 // q)
                out[right[j][0], x[0]] += rest * ((p - q) ** 2 // p)
    return [(s, o, v) for (s, o), v in out.items()]


SUMS = "lang string, source string, item string, value long"
_FIELDS = ("terms", "kept", "sources", "sizes", "counts", "block")


def _play(batches):
    for b in batches:
        hosts, guests = b.column(1), b.column(2)
        out = [(b.column(0)[k].as_py(), *x) for k in range(b.num_rows) for x in meet(hosts[k].as_py(), guests[k].as_py())]
        if out:
            yield pa.record_batch([pa.array([x[c] for x in out], pa.int64() if c == 3 else pa.string()) for c in range(4)], names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the
    top terms whose share in the source is above the language's."""
    spark = docs.sparkSession
    tune(spark)
    counts, counts_at = materialize(source_counts(docs, min_docs, text_col, lang_col, source_col), "counts")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups, groups_at = materialize(groups.join(sizes, ["lang", "source"], "left").fillna(0, ["size"]), "groups")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_if("first").alias("kept"), F.count("*").alias("rows"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left").fillna(0)
    langs = langs.withColumns({"slices": F.greatest(F.lit(1), F.ceil(F.col("rows") / SLICE_ROWS)), "seats": F.least(F.lit(MAX_SEATS), F.ceil(F.col("sources") / SEAT_SOURCES))}).drop("rows", "sources")
    langs, langs_at = materialize(langs, "langs")

    seat = F.pmod(F.xxhash64("source"), F.col("seats"))
    known = groups.join(langs, "lang").withColumn("seat", seat)
    marks = known.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    columns = ["lang", "slice", "seat", "source", "size", "whole", "kept", "term", "n", "total"]
    marks = marks.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}).select(columns)
    cells = counts.join(known, ["lang", "source"]).withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices"))).select(columns)
    packed = cells.unionByName(marks).groupBy("lang", "slice").applyInArrow(lambda t: pack_slice(t, top), PACKED)
    packed, packed_at = materialize(packed, "seats")

    # the tournament: (seat + other) mod (n - 1) is the round, the last of n seats takes those that would meet themselves
    n = int(langs.agg(F.max("seats")).first()[0] or 0)
    n += n % 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.struct(*_FIELDS)
    resident = packed.select("lang", "slice", "seat", block.alias("own")).repartition(parts, "lang", "slice", "seat").persist(StorageLevel.DISK_ONLY)
    played = new_path(spark, "rounds")
    resident.select("lang", "own", F.lit(None).cast(resident.schema["own"].dataType).alias("guest")).mapInArrow(_play, SUMS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).write.parquet(f"{played}/round=0")
    for r in range(n - 1 if n > 1 else 0):
        other = F.pmod(F.lit(r) - F.col("seat"), F.lit(n - 1))
        other = F.when(F.col("seat") == n - 1, F.lit(r * (n // 2) % (n - 1))).when(other == F.col("seat"), F.lit(n - 1)).otherwise(other).cast("long")
        hosts = resident.where(F.col("seat") < other)
        guests = packed.where(F.col("seat") > other).select("lang", "slice", other.alias("seat"), block.alias("guest"))
        met = hosts.join(guests.hint("merge"), ["lang", "slice", "seat"]).select("lang", "own", "guest").mapInArrow(_play, SUMS)
        met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).write.parquet(f"{played}/round={r + 1}")
    resident.unpersist()
    pairs = spark.read.schema(SUMS).parquet(*[f"{played}/round={r}" for r in range(max(1, n))])
    forget(spark, counts_at, groups_at, langs_at)

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = packed.select("lang", F.explode("best").alias("b")).select("lang", "b.*").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
