"""MinHash near-dedup by weighted Jaccard similarity: BagMinHash signatures, bands, verified multiset overlap.

A text is the multiset of its five-word shingles (words as in decontaminate; a text of one to four words is one
shingle). Weights are discretised in unit steps, grouped into root intervals [0,1), [1,2), [2,4), [4,8) ... Each root
of each shingle is a Poisson process at the rate of its length, whose points carry a register and a position; the bits
of the position are the interval's successive halvings, and a point counts if it falls below the weight. A register
keeps the earliest point; two texts agree in a register with probability sum(min) / sum(max). Points are drawn up to a
horizon at which, as a rule, all registers are filled, and further where not, so few points of long texts are drawn.

Candidates share a band of registers: 32 bands of 4, which all differ for one in 2 * 10^7 pairs of similarity 0.8. Equal
multisets are one class from the start. A band's bucket links its members to its first member; buckets that still hold
several components then compare members of different components, in blocks, so that a large bucket is split over many
tasks. A pair is put aside only if its sizes rule it out; or if the parities of its elements (discretised, hashed to 1024
bits) differ in more bits than the texts may have different elements, which is exact; or if its sketches (the least hash of
the elements in each of 512 bins, 4 bits of each) differ in more bins than six deviations above what similarity at the
threshold gives, which is one in 10^9 pairs at the threshold and fewer above. Every other pair is verified by the overlap
of the two texts' multisets, so no link is made without it. Groups of copies cost their size, not its square.

Defined results: each row is a document, also where ids repeat; null, empty and wordless texts, and null ids, link with
nothing; ties and repeated rows fall into one class; texts of any length are taken whole, in slices of about 1 MiB of
texts; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, connected_components, forget, fresh, materialize, may_be_in, tidy, tune
from .decontaminate import _FOLD
from .substrings import SLICE_BYTES, _mix, _rolled, hash_words

REGISTERS, BANDS = 128, 32
SHINGLE = 5
#: Bins of a sketch and bits of a bin (0: no element).
BINS, SKETCH_BITS = 512, 4
#: Bits of the parities.
PARITIES = 1024
#: Members of a bucket in one block; a bucket's blocks meet pair by pair.
BLOCK = 512


def shingles(texts: list[bytes], n: int = SHINGLE):
    """(text number, shingle hash, count), sorted, of texts whose words are already folded."""
    import numpy as np

    h, of = hash_words(texts)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text, value = [], []
    if len(h) >= n:
        at = np.flatnonzero(of[: len(h) - n + 1] == of[n - 1 :])
        text.append(of[at])
        value.append(_rolled(h, n, 3)[at])
    size = np.bincount(of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            x = np.full(len(short), k, np.uint64)
            for j in range(k):
                x = _mix(x + h[first[short] + j])
            text.append(short)
            value.append(x)
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])]))
    return text[new], value[new], np.diff(np.append(new, len(text)))


def signatures(text, value, weight, texts: int, registers: int = REGISTERS):
    """Earliest points by text and register (as float64; inf for texts without shingles)."""
    import numpy as np

    sig = np.full((texts, registers), np.inf)
    total = np.bincount(text, weights=weight, minlength=texts)
    todo, grow = total > 0, 3.0
    while todo.any():
        horizon = np.where(total > 0, registers * (math.log(registers) + grow) / np.maximum(total, 1), 0)
        own = todo[text]
        t0, v0, w0 = text[own], value[own], weight[own]
        flat = np.full(texts * registers, np.inf)
        root, low, size = 0, 0, 1
        while len(t0):
            t, w, x = t0, w0, np.zeros(len(t0))
            seed = _mix(v0 + np.uint64((root * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1))
            j = 0
            while len(t):
                j += 1
                r = _mix(seed + np.uint64(j * 0xBF58476D1CE4E5B9 & (1 << 64) - 1))
                x = x - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / size
                on = x <= horizon[t]
                t, w, x, seed, r = t[on], w[on], x[on], seed[on], r[on]
                q = _mix(r ^ np.uint64(0xD6E8FEB86659FD93))
                below = low + (q >> np.uint64(16)) % np.uint64(size) < w
                np.minimum.at(flat, t[below] * registers + (q[below] % np.uint64(registers)).astype(np.int64), x[below])
            root, low, size = root + 1, low + size, size if root == 0 else size * 2
            more = w0 > low
            t0, v0, w0 = t0[more], v0[more], w0[more]
        flat = flat.reshape(texts, registers)
        sig[todo] = flat[todo]
        todo = todo & ~np.isfinite(sig).all(axis=1)
        grow = grow * 2 + 4
    return sig


def _bytes(x):
    return x.encode("utf-8", "surrogatepass").translate(_FOLD)


def _slices(texts, most_rows: int, most_bytes: int = SLICE_BYTES):
    """(row numbers, folded texts) of a column in slices of so many rows and bytes at most, one text at least."""
    rows, out, size = [], [], 0
    for k, x in enumerate(texts):
        t = x.as_py()
        t = b"" if t is None else _bytes(t)
        if rows and (size + len(t) > most_bytes or len(rows) == most_rows):
            yield rows, out
            rows, out, size = [], [], 0
        rows.append(k)
        out.append(t)
        size += len(t)
    if rows:
        yield rows, out


def sketches(text, value, weight, texts: int):
    """Longs of each text: bit k of 64 bins together, then the parities. An element is a shingle at one of its unit steps
    of weight."""
    import numpy as np

    each = np.repeat(np.arange(len(value)), weight)
    step = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
    h = _mix(value[each] + _mix(step.astype(np.uint64) + np.uint64(77)))
    least = np.full(texts * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, text[each] * BINS + (h % np.uint64(BINS)).astype(np.int64), h)
    code = np.where(least == np.iinfo(np.uint64).max, 0, _mix(least) % np.uint64((1 << SKETCH_BITS) - 1) + np.uint64(1)).astype(np.uint64).reshape(texts, BINS)
    bits = [np.packbits((code >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1).view(">u8").astype(np.uint64).view(np.int64) for k in range(SKETCH_BITS)]
    odd = np.bincount(text[each] * PARITIES + (h >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=texts * PARITIES) & 1
    odd = np.packbits(odd.astype(np.uint8).reshape(texts, PARITIES), axis=1).view(">u8").astype(np.uint64).view(np.int64)
    return np.concatenate([np.stack(bits, axis=2).reshape(texts, -1), odd], axis=1)


def _lists(x):
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _keys(text, value, weight, texts: int):
    """Two hashes of each text's multiset."""
    import numpy as np

    out = []
    for c in (11, 12):
        k = np.zeros(texts, np.uint64)
        np.add.at(k, text, _mix(value + np.uint64(c)) * weight.astype(np.uint64))
        out.append(_mix(k).view(np.int64))
    return out


def _sign(batches):
    """Rows (id, text, h) -> (id, h, k1, k2, size, bands, f): hashes of the multiset, how many shingles it has, hashes of
    the bands, and the sketch; keys are null for texts without shingles and null ids."""
    import numpy as np

    names = ["id", "h", "k1", "k2", "size", "bands", "f"]
    per = REGISTERS // BANDS
    for b in batches:
        for rows, texts in _slices(b.column(1), 1024):
            own = b.slice(rows[0], len(rows))
            text, value, weight = shingles(texts)
            sig = signatures(text, value, weight, len(texts)).view(np.uint64)
            k1, k2 = _keys(text, value, weight, len(texts))
            sig = _mix(sig)
            band = np.zeros((len(texts), BANDS), np.uint64)
            for j in range(per):
                band = _mix(band + sig[:, j::per])
            band = _mix(band + np.arange(BANDS, dtype=np.uint64))
            size = np.bincount(text, weights=weight, minlength=len(texts)).astype(np.int64)
            none = (size == 0) | np.asarray(own.column(0).is_null())
            k1, k2 = pa.array(k1, mask=none), pa.array(k2, mask=none)
            cols = [own.column(0), own.column(2), k1, k2, pa.array(size), _lists(band.view(np.int64)), _lists(sketches(text, value, weight, len(texts)))]
            yield pa.record_batch(cols, names=names)
    tidy()


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingle multisets."""
    return float(_overlaps([_bytes(a)], [_bytes(b)])[0])


def _overlaps(left: list[bytes], right: list[bytes]):
    """Weighted Jaccard similarity of each text on the left and its partner on the right."""
    import numpy as np

    n = len(left)
    text, value, weight = shingles(left + right)
    total = np.bincount(text, weights=weight, minlength=2 * n)
    pair = text % n
    order = np.lexsort((value, pair))
    pair, value, weight = pair[order], value[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
    low = np.bincount(pair[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=n)
    return low / np.maximum(total[:n] + total[n:] - low, 1)


def _verify(batches):
    """Rows (a, b, text of a, text of b) -> (a, b, s)."""
    import numpy as np

    for b in batches:
        out, left = [], b.column(2)
        for rows, right in _slices(b.column(3), 256, SLICE_BYTES // 2):
            out.append(_overlaps([_bytes(left[k].as_py()) for k in rows], right))
        if out:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.concatenate(out))], names=["a", "b", "s"])
    tidy()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, s) of pairs (a, b) of nodes, by their texts (node, text)."""

    def run(batches):
        yield from _verify(batches)

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, s double")


LONGS = BINS // 64 * SKETCH_BITS


def _spread(x: str) -> list:
    """Columns of a node's size and sketch: z, f0, f1, ..., p0, p1, ... (parities), and o0, o1, ..., the bins that have
    elements. None is null, so that the generated code of a comparison stays short enough to be compiled."""
    full = [F.expr("coalesce(" + " | ".join(f"f[{k + j}]" for j in range(SKETCH_BITS)) + ", 0L)").alias(f"o{x}{k // SKETCH_BITS}") for k in range(0, LONGS, SKETCH_BITS)]
    return [F.coalesce("size", F.lit(0)).alias(f"z{x}"), *[F.expr(f"coalesce(f[{k}], 0L)").alias(f"f{x}{k}") for k in range(LONGS)], *[F.expr(f"coalesce(f[{LONGS + k}], 0L)").alias(f"p{x}{k}") for k in range(PARITIES // 64)], *full]


def may_link(threshold: float) -> str:
    """SQL: the sizes and sketches of a and b allow similarity `threshold`. Of n bins with elements of the union, which has
    u elements at the threshold, as many differ as in n draws without replacement."""
    at = range(0, LONGS, SKETCH_BITS)
    differ = " + ".join("bit_count(" + " | ".join(f"(fa{k + j} ^ fb{k + j})" for j in range(SKETCH_BITS)) + ")" for k in at)
    n = "(" + " + ".join(f"bit_count(oa{k} | ob{k})" for k in range(len(at))) + ")"
    u = f"((za + zb) / {1 + threshold})"
    most = f"{1 - threshold} * {n} + 6 * sqrt({threshold * (1 - threshold)} * {n} * greatest({u} - {n}, 0) / greatest({u} - 1, 1)) + 1"
    odd = " + ".join(f"bit_count(pa{k} ^ pb{k})" for k in range(PARITIES // 64))
    return f"least(za, zb) >= {threshold} * greatest(za, zb) and {odd} <= (za + zb) * {(1 - threshold) / (1 + threshold) + 1e-9} and {differ} <= {most}"


def _rest(member: DataFrame, links: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members of different components of buckets (node, bucket) that hold several, if they may link. A bucket's
    members are dealt to blocks, and each pair of blocks is a key of its own."""
    comp = connected_components(links)
    inside = member.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    opened = inside.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    rest = inside.join(opened.select("bucket", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("nb")), "bucket").join(classes.select("node", "size", "f", "bands"), "node")
    rest, rest_at = materialize(rest.withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb"))), "open")
    ends = {}
    for x, others, cell in (("a", "sequence(i, nb - 1)", "i * nb + o"), ("b", "sequence(0L, i)", "o * nb + i")):
        own = rest.withColumn("o", F.explode(F.expr(others))).withColumn("cell", F.expr(cell))
        ends[x] = own.select("bucket", "cell", F.col("i").alias(f"i{x}"), F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("bands").alias(f"b{x}"), *_spread(x))
    # a pair that shares several buckets comes once
    cond = f"(ia < ib or a < b) and ca <> cb and {may_link(threshold)} and bucket = array_min(array_intersect(ba, bb))"
    pairs, _ = materialize(ends["a"].join(ends["b"], ["bucket", "cell"]).where(cond).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    forget(links.sparkSession, rest_at)
    return pairs


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """documents: (id, copy_of, component_id, kept), one row per row of docs; links: verified (a, b, s) between
    representatives, s >= threshold; rows: (id, h, kept), where h is the xxhash64 of the text as a string.

    copy_of is the smallest id with the same multiset, component_id the smallest id reachable by links. Bands are made
    for thresholds of 0.8 and more; below, fewer pairs become candidates.
    """
    spark = docs.sparkSession
    tune(spark)

    def sign(batches):
        yield from _sign(batches)

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    signed, _ = materialize(src.select("id", "text", "h").mapInArrow(sign, "id long, h long, k1 long, k2 long, size long, bands array<long>, f array<long>"), "signatures")
    classes = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "bands", "f")])
    classes, _ = materialize(classes.withColumn("node", F.col("rep")), "classes")
    alike = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    shared = not alike.isEmpty()
    if shared:  # an id with several texts: its first class keeps the id as its node, the others get a hash
        nth = F.row_number().over(Window.partitionBy("rep").orderBy("k1", "k2"))
        odd = classes.join(alike, "rep", "left_semi").withColumn("node", F.when(nth > 1, F.xxhash64("k1", "k2")).otherwise(F.col("rep")))
        classes, _ = materialize(classes.join(alike, "rep", "left_anti").select(*classes.columns).unionByName(odd.select(*classes.columns)), "classes")

    # members of buckets that hold more than one class
    member = classes.select("node", F.explode("bands").alias("bucket"))
    heads = member.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("bucket", "head")
    member, member_at = materialize(member.join(heads, "bucket"), "buckets")
    named = member.select("node").distinct().join(classes.select("node", "rep", "k1"), "node")
    named, named_at = materialize(named.select(F.col("rep").alias("id"), "node", "k1"), "named")
    texts = may_be_in(src.where("id is not null and text is not null").select("id", "text", "h"), bit_table(named.select("id")))
    texts = texts.join(signed.select("id", "h", "k1").distinct().join(named, ["id", "k1"]).select("id", "h", "node"), ["id", "h"])
    texts, texts_at = materialize(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    a, b = (classes.select(F.col("node").alias(x), *_spread(x)) for x in "ab")
    star = member.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    star, _ = materialize(star.join(b, "b").join(a, "a").where(may_link(threshold)).select("a", "b"), "pairs")
    known, known_at = materialize(verified(star, texts).where(F.col("s") >= threshold), "links")

    pairs = _rest(member.select("node", "bucket"), known, classes, threshold)
    links, _ = materialize(known.unionByName(verified(pairs, texts).where(F.col("s") >= threshold)), "links")
    comp, _ = materialize(connected_components(links), "components")
    forget(spark, member_at, named_at, texts_at, known_at)

    of = classes.select("k1", "k2", "node", "rep").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if shared:
        root = F.min(F.struct("rep", "node"))
        of = of.join(of.groupBy("component").agg(root.alias("root")), "component").select("k1", "k2", "node", "rep", F.col("root.node").alias("component"), F.col("root.rep").alias("least"))
    else:
        of = of.withColumn("least", F.col("component"))
    of, _ = materialize(of.select("k1", "k2", "rep", "least", (F.col("node") == F.col("component")).alias("first")), "classes")
    out = signed.select("id", "h", "k1", "k2").join(of, ["k1", "k2"], "left")
    documents = out.select(F.col("id").alias(id_col), F.coalesce("rep", "id").alias("copy_of"), F.coalesce("least", "id").alias("component_id"))
    kept = F.coalesce(F.col("first") & (F.col("id") == F.col("rep")), F.lit(True))
    return {"documents": documents.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True))), "links": links, "rows": out.select("id", "h", "k1", "k2", kept.alias("kept"))}


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates (the smallest id, once), with the columns it had.

    Nulls: rows with a null id, and rows with null, empty or wordless texts, link with nothing and stay. Of rows with one
    id and the same words one stays: that of the smallest text hash, then of the smallest hash of the whole row, so that
    retries agree. Rows with one id and texts that aren't alike are documents of their own. Columns may have any names.
    """
    rows = near_duplicates(docs, threshold, id_col, text_col)["rows"].where("kept and id is not null")
    some = rows.where("k1 is not null").groupBy("id", "k1", "k2").agg(F.min("h").alias("h")).select("id", "h")
    some = some.unionByName(rows.where("k1 is null").select("id", "h")).distinct()
    i, h, all_ = fresh(docs.columns, "id", "text_hash", "row")
    some = some.select(F.col("id").alias(i), F.col("h").alias(h))
    keyed = docs.where(F.col(id_col).isNotNull()).withColumns({i: F.col(id_col).cast("long"), h: F.xxhash64(F.col(text_col).cast("string"))})
    one = keyed.join(some, [i, h], "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = one.groupBy(i, h).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias(all_))
    return one.select(f"{all_}.*").unionByName(docs.where(F.col(id_col).isNull()))
