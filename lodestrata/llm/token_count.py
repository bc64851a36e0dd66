"""Token counts by heap-and-linked-list byte-pair merging.

For each chunk of a text the initial symbols are its characters (a character outside the vocabulary stands for its
UTF-8 bytes, the byte-fallback pieces). A heap holds the adjacent pairs whose concatenation is a piece, by rank (best
score first, leftmost on ties); the best is popped, merged in a linked list, and its new neighbours are pushed. The
count is the number of initial symbols less the merges; no identifier is ever made.

A piece never holds a word mark after another character, so a text falls apart into chunks (a run of word marks and
what follows) that merge independently. Counts of chunks are kept in a bounded per-worker table.

Defined results: null or empty text has 0 bytes and 0 tokens; rows and ids pass through as they are, repeated or null.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks kept per worker; when full the table is emptied, which only costs time.
CACHE_ENTRIES = 400_000


class PairMerger:
    """Counts the pieces that byte-pair merging leaves, for a sentencepiece BPE vocabulary with byte fallback."""

    def __init__(self, model_path: str, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece has a word mark after another character: chunks would not be independent")
        if sp.normalize(" a  b") != f"{MARK}{MARK}a{MARK}{MARK}b":
            raise ValueError("only vocabularies with a dummy prefix and no normalisation are supported")
        self.most, self.seen = cache_entries, {}

    def merge(self, s: str) -> int:
        """Symbols left of one chunk."""
        rank, n = self.rank, len(s)
        sym = list(s)
        weight = [1 if c in rank else len(c.encode()) for c in sym]
        left, total = n, sum(weight)
        if left < 2:
            return total
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := s[i : i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if sym[i] else -1
            if j < 0 or sym[i] + sym[j] != p:
                continue
            total -= weight[i] + weight[j] - 1
            sym[i], weight[i], sym[j] = p, 1, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := p + sym[k]) in rank:
                    heapq.heappush(heap, (rank[q], i, q))
            h = before[i]
            if h >= 0 and (q := sym[h] + p) in rank:
                heapq.heappush(heap, (rank[q], h, q))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            chunks = [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        else:
            chunks = text.split(" ")
        seen = self.seen
        counts = list(map(seen.get, chunks))
        if None in counts:
            if len(seen) > self.most:
                seen.clear()
            for k, c in enumerate(counts):
                if c is None:
                    w = chunks[k]
                    if (c := seen.get(w)) is None:
                        c = self.merge(MARK + w)
                        if len(w) <= 64:
                            seen[w] = c
                    counts[k] = c
        return sum(counts)


_MERGERS: dict[str, PairMerger] = {}


def merger(model_path: str) -> PairMerger:
    """One per worker and file."""
    if model_path not in _MERGERS:
        _MERGERS[model_path] = PairMerger(model_path)
    return _MERGERS[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; one pass, no shuffle."""
    tune(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        m = merger(model_path)
        for b in batches:
            n_bytes, n_tokens = [], []
            for x in b.column(1):
                t = x.as_py()
                n_bytes.append(0 if not t else len(t.encode()))
                n_tokens.append(m.count(t))
            yield pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
