"""Letters of texts, as the operators here tell words apart."""

from __future__ import annotations

from ..functions.arrow_words import numbered_words, only, runs

__all__ = ["ascii_letters", "latin_letters", "numbered_words", "runs"]

#: A-Z lower-cased, other ASCII characters that are not letters as spaces, and all beyond ASCII as it is.
ascii_letters = only("abcdefghijklmnopqrstuvwxyz")


def latin_letters(data):
    """The same, but all beyond ASCII is a space that is not U+00C0 to U+00FF: the byte C3 and what follows it."""
    import numpy as np

    out = ascii_letters(data)
    lead = data == 0xC3
    kept = lead.copy()
    kept[1:] |= lead[:-1]
    out[(data >= 0x80) & ~kept] = 32
    return out
