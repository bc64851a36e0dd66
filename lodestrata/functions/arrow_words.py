"""Words of whole texts, counted in tasks: bytes are mapped at once, words are numbered, and only numbers are grouped."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are counted together.
HELD_BYTES = 16 << 20


def only(characters: str, beyond: bool = True):
    """A function of bytes (a NumPy array): A-Z lower-cased, other ASCII characters than these as spaces; what is beyond ASCII
    as it is, or as spaces too."""
    import numpy as np

    to = np.arange(256, dtype=np.uint8)
    to[: 128 if beyond else 256] = 32
    for c in characters.encode():
        to[c] = c
    to[ord("A") : ord("Z") + 1] = to[ord("a") : ord("z") + 1]
    return lambda data: to[data]


def _mapped(text, letters):
    import numpy as np

    text = pa.concat_arrays([pc.fill_null(text.cast(pa.large_string()), "")])
    _, ends, data = text.buffers()
    at = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text) or at[0] == at[-1]:
        return pa.array([""] * len(text), pa.large_string())
    out = letters(np.frombuffer(data, np.uint8)[at[0] : at[-1]])
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(out))


def runs(key):
    """The distinct numbers of an array in order, and how often each occurs (sorted: no table of them is kept)."""
    import numpy as np

    key = np.sort(key)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def numbered_words(batches, column: int, letters, least: int = 1):
    """(table, row, code, words) of some batches at a time: for each word of at least so many characters in each text, the
    text's row in the table and the word's number in words."""
    import numpy as np

    def counted(held):
        t = pa.Table.from_batches(held).combine_chunks()
        text = t.column(column)
        parts = pc.ascii_split_whitespace(_mapped(text.chunk(0) if text.num_chunks else pa.array([], pa.string()), letters))
        words = pc.dictionary_encode(pc.list_flatten(parts))
        row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
        code, words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        fits = pc.greater_equal(pc.utf8_length(words), max(1, least)).to_numpy(zero_copy_only=False)
        if not fits.all():
            on = fits[code]
            row, code = row[on], code[on]
        return t, row, code, words

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size > HELD_BYTES:
            yield counted(held)
            held, size = [], 0
    if held:
        yield counted(held)
