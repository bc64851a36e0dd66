"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record file is a run of frames: length of the payload (uint64), masked CRC-32 of those eight bytes (uint32), payload,
masked CRC-32 of the payload (uint32); all little-endian. A mask turns the checksum right by 15 bits and adds a
constant, so that a checksum stored inside data is not mistaken for data's own. A payload is doc_id (int64), a flag
byte (1: doc_id is null), the width of an id (2 or 4 bytes, by the vocabulary), and the ids. Beside each file lies its
index: for each record its offset, doc_id and number of ids (int64 each), so that records can be read in any order.

Documents go to files by ranges of doc_id, sorted, so files in order are the corpus in ascending doc_id order (null
first; rows of one id by a hash of the text, which also parts them when they are many). Each task writes under a name of its own and only names that the successful tasks
return enter the manifest, so retried or speculative tasks cannot mix. Files are in the folder that the session's
checkpoint setting names.

Defined results: null and empty texts have the end id only; texts of any length are one record; repeated ids and rows
are records of their own; other columns, whatever their names, are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_uri, new_path, tidy, tune

MASK = 0xA282EAD8
FRAME, HEAD = struct.Struct("<QI"), struct.Struct("<qBB")
#: Pieces that a generation keeps.
CACHE_ENTRIES = 120_000


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def frames(stream):
    """Payloads of an open record file; a wrong checksum or a cut record is an error."""
    while head := stream.read(FRAME.size):
        if len(head) < FRAME.size:
            raise ValueError("cut record")
        n, c = FRAME.unpack(head)
        if masked(head[:8]) != c:
            raise ValueError("wrong checksum of a length")
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked(body[:n]) != int.from_bytes(body[n:], "little"):
            raise ValueError("wrong checksum of a record")
        yield body[:n]


# The pieces that the vocabulary's byte-level splitter makes, for characters below U+0250, where letters,
# numbers and white space are the same in every version of Unicode.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PIECES = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-\u024f]")


class _Ids(dict):
    """Ids by piece; what is missing comes from the generation before or from the library's merges."""

    def __init__(self, tokenize, shown: dict, code: str, old: dict):
        self.tokenize, self.shown, self.code, self.old = tokenize, shown, code, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array(self.code, [t.id for t in self.tokenize(piece.translate(self.shown))]).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts as the tokenizers library gives them, kept by piece.

    A byte-level splitter cuts a text into pieces; the ids of a piece come from the library's merges once and are kept in
    a table of two generations, of which the older goes when the younger is full. Texts with characters from U+0250 on
    are cut at spaces that no white space follows, where a piece always starts, and their parts with such characters cut
    by the library. Texts in which white space or the end follows a space as well, or with a special token's string, go
    to the library whole.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.most = cache_entries
        #: How the library's byte-level splitter shows bytes: printable Latin-1 as itself, the others from U+0100 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        odd = [b for b in range(256) if b not in plain]
        shown = [chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)]
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x250)}
        self.ids = _Ids(self.tok.model.tokenize, self.shown, self.code, {})

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _library(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _pieces(self, pieces: list[str]) -> bytes:
        out = b"".join(map(self.ids.__getitem__, pieces))
        if len(self.ids) > self.most:
            self.ids.old = {}
            self.ids = _Ids(self.ids.tokenize, self.shown, self.code, self.ids)
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            return self._library(text)
        if not _OTHER.search(text):
            return self._pieces(_PIECES.findall(text))
        first, *rest = text.split(" ")
        if any(not w or w[0].isspace() for w in rest):
            return self._library(text)
        chunks = [first, *[" " + w for w in rest]]
        return b"".join([self._chunk(c) if _OTHER.search(c) else self._pieces(_PIECES.findall(c)) for c in chunks if c])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that the library cuts; kept like a piece."""
        ids = self.ids.get(chunk) or self._library(chunk)
        if len(chunk) <= 64:
            self.ids[chunk] = ids
        return ids


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _write_part(batches, tokenizer_path: str, end_id: int, base: str):
    """One task's sorted rows to one file and its index; gives the manifest's row."""
    import pyarrow.fs as fs
    import numpy as np

    enc, name = encoder(tokenizer_path), f"records-{uuid.uuid4().hex}"
    end, width = enc.pack([end_id]), int(enc.kind[2])
    out = index = first = last = None
    at = docs_n = tokens = 0
    for b in batches:
        if not b.num_rows:
            continue
        if out is None:
            store, root = fs.FileSystem.from_uri(base)
            store.create_dir(root, recursive=True)
            out, index = store.open_output_stream(f"{root}/{name}.bin"), store.open_output_stream(f"{root}/{name}.idx")
            first = b.column(0)[0].as_py()
        lines = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids = enc.encode(t.as_py()) + end
            lines.append((at, i or 0, n := len(ids) // width))
            at += out.write(rec := frame(HEAD.pack(i or 0, i is None, width) + ids)) or len(rec)
            tokens += n
        last = b.column(0)[-1].as_py()
        docs_n += b.num_rows
        index.write(np.asarray(lines, dtype="<i8").tobytes())
    if out is not None:
        out.close(), index.close()
        yield pa.record_batch([pa.array([x]) for x in (f"{base}/{name}.bin", docs_n, tokens, at)] + [pa.array([x], pa.int64()) for x in (first, last, TaskContext.get().partitionId())], names=["path", "docs", "tokens", "bytes", "first_id", "last_id", "part"])
    tidy()


def _read_files(batches, id_col: str):
    import pyarrow.fs as fs
    import numpy as np

    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, at = fs.FileSystem.from_uri(path)
            got = [[], [], [], []]
            with store.open_input_stream(at, buffer_size=1 << 20) as f:
                for p in frames(f):
                    i, null, width = HEAD.unpack_from(p)
                    ids = np.frombuffer(p, dtype=f"<u{width}", offset=HEAD.size)
                    for col, x in zip(got, (None if null else i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        col.append(x)
                    start += len(ids)
                    if len(got[0]) == 10_000:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in got], names=[id_col, "start", "n_tokens", "ids_crc32"])
                        got = [[], [], [], []]
            if got[0]:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in got], names=[id_col, "start", "n_tokens", "ids_crc32"])


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, to: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text, write the files and give the manifest, one row per file in corpus order.

    One range shuffle of (id, text) by the session's shuffle partitions; the manifest is the only thing collected
    and grows with the number of files.
    """
    spark = docs.sparkSession
    tune(spark)
    base = arrow_uri(to or new_path(spark, "records"))
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # the hash spreads rows that share an id, or have none, over several files
    src = src.repartitionByRange("id", "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h", F.col("text").asc_nulls_first()).select("id", "text")

    def run(batches):
        yield from _write_part(batches, tokenizer_path, end_id, base)

    rows = src.mapInArrow(run, "path string, docs long, tokens long, bytes long, first_id long, last_id long, part long").collect()
    rows.sort(key=lambda r: r["part"])
    out, start = [], 0
    for r in rows:
        out.append(r.asDict() | {"start": start})
        start += r["tokens"]
    return out


def read_records(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, read from the files, checksums verified."""
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long"
    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    files = files.repartition(max(1, len(manifest)))

    def run(batches):
        yield from _read_files(batches, id_col)

    return files.mapInArrow(run, schema)


def read_record(path: str, k: int) -> tuple[int | None, list[int]]:
    """The k-th record of a file through its index: (doc_id, ids)."""
    import pyarrow.fs as fs
    import numpy as np

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at[: -len(".bin")] + ".idx") as f:
        f.seek(24 * k)
        offset = int(np.frombuffer(f.read(8), "<i8")[0])
    with store.open_input_file(at) as f:
        f.seek(offset)
        p = next(frames(f))
    i, null, width = HEAD.unpack_from(p)
    return (None if null else i), np.frombuffer(p, dtype=f"<u{width}", offset=HEAD.size).tolist()
