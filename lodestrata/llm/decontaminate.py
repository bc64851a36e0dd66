"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Every window of an item's words (all its
words, if it has fewer) is a pattern of the automaton, over word numbers. A text is scanned once; hits are word runs,
mapped back to character offsets of the original text.

The automaton is built from a block of items whose text is at most ``block_bytes`` (measured first), so what is sent
to the workers is bounded. A larger benchmark is scanned in several blocks, each with an automaton of its own, and
the hits of a text are merged; the results are the same.

Defined results: null and empty texts have no words and no hits; items without words, and null items, have no
windows; an item with a null id marks words but is in no list of items; repeated rows are judged each on its own;
empty tables give no rows or no hits; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

#: Bytes to bytes: A-Z lowered, whatever is no word byte to a space. Bytes over 127 belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Bytes of item text in one automaton; its nodes take about 60 times that in each worker.
BLOCK_BYTES = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WindowAutomaton:
    """Finds the windows of the items in a list of words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            for k in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[k : k + window]), set()).add(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if found else None
        for p, ids in found.items():
            self.tree.add_word(p, (len(p), ids))
        if found:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs of hit words as [start, end), and the items with a window there."""
        runs: list[tuple[int, int]] = []
        items: set = set()
        if self.tree is None or not words:
            return runs, items
        number = self.number
        for end, (n, ids) in self.tree.iter(tuple([number.get(w, 0) for w in words])):
            start, end = end - n + 1, end + 1
            items |= ids
            while runs and runs[-1][1] >= start:  # ends ascend, so only the last runs can touch
                start = min(start, runs.pop()[0])
            runs.append((start, end))
        return runs, items


_BUILT: dict[tuple, WindowAutomaton] = {}


def _automaton(key, items, window) -> WindowAutomaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WindowAutomaton(items, window)
    return _BUILT[key]


def _scan(batches, key, items, window, schema):
    hashed = "h" in schema.names
    tree = _automaton(key, items, window)
    for b in batches:
        out = []
        for i, x in zip(b.column(0).to_pylist(), b.column(1)):
            text = x.as_py()
            w = words_of(text)
            runs, ids = tree.scan(w)
            spans = []
            if runs:
                at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                spans = [{"start": at[a][0], "end": at[z - 1][1]} for a, z in runs]
            row = (i, len(w), [{"start": a, "end": z} for a, z in runs], spans, [x for x in ids if x is not None])
            out.append((*row, hashlib.sha256((text or "").encode()).hexdigest() + str(text is None)) if hashed else row)
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out else [pa.array([], t.type) for t in schema], schema=schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, n_words, runs, spans, items) of every text: hit words as word runs and as character offsets of the
    original, and the ids (as strings, sorted) of the items with a window in it. One pass over the texts for each
    block of the benchmark; no shuffle if there is one block."""
    spark = docs.sparkSession
    tune(spark)
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    ddl = f"{id_col} long, n_words long, runs array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>, items array<string>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = [(id_col, pa.int64()), ("n_words", pa.int64()), ("runs", span), ("spans", span), ("items", pa.list_(pa.string()))]
    if blocks > 1:
        ddl, fields = f"{ddl}, h string", [*fields, ("h", pa.string())]
    schema, call = pa.schema(fields), uuid.uuid4().hex

    def scanned(k: int) -> DataFrame:
        part = b if blocks == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about block_bytes of text

        def run(batches):
            yield from _scan(batches, (call, k, window), sent.value, window, schema)

        return src.mapInArrow(run, ddl)

    if blocks == 1:
        return scanned(0).withColumn("items", F.array_sort(F.array_distinct("items")))
    # rows alike in id and text have the same hits in every block: one of them is kept for each block, and their number
    parts = scanned(0).withColumn("block", F.lit(0))
    for k in range(1, blocks):
        parts = parts.unionByName(scanned(k).withColumn("block", F.lit(k)))
    one = parts.groupBy(id_col, "h", "block").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("n_words", "runs", "spans", "items")])
    both = F.flatten(F.collect_list(F.zip_with("runs", "spans", lambda r, c: F.struct(r["start"].alias("start"), r["end"].alias("end"), c["start"].alias("a"), c["end"].alias("z")))))
    merged = one.groupBy(id_col, "h").agg(F.max("rows").alias("rows"), F.max("n_words").alias("n_words"), both.alias("both"), F.flatten(F.collect_list("items")).alias("items"))
    merged = merged.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("both", joined("both"))
    for name, x, y in (("runs", "start", "end"), ("spans", "a", "z")):
        merged = merged.withColumn(name, F.expr(f"transform(both, t -> named_struct('start', t.{x}, 'end', t.{y}))"))
    return merged.withColumn("_n", F.explode(F.expr("sequence(1L, rows)"))).select(id_col, "n_words", "runs", "spans", "items")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that no window of the benchmark occurs in, with the columns they had.

    A benchmark of several blocks is applied block by block, each result written before the next."""
    spark = docs.sparkSession
    tune(spark)
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    call = uuid.uuid4().hex
    for k in range(blocks):
        part = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about block_bytes of text

        def run(batches, k=k, sent=sent):
            tree = _automaton((call, k, window), sent.value, window)
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array([not tree.scan(words_of(x.as_py()))[0] for x in batch.column(text_col)]))

        docs = docs.mapInArrow(run, docs.schema)
        if k < blocks - 1:
            docs, _ = materialize(docs, "clean")
    return docs


def joined(col: str):
    """Word runs (start, end) that touch or overlap, merged, with their character offsets (a, z)."""
    return F.expr(
        f"aggregate(array_sort({col}), cast(array() as array<struct<start:int,end:int,a:int,z:int>>), (m, x) -> case when size(m) > 0 and element_at(m, -1).end >= x.start "
        "then concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, x.end), 'a', element_at(m, -1).a, 'z', greatest(element_at(m, -1).z, x.z)))) else concat(m, array(x)) end)"
    )
