"""Terms of texts: runs of letters (and digits) and of everything beyond ASCII, with A-Z lower-cased.

Works on UTF-8 bytes: a byte from 0x80 on belongs to a code point beyond ASCII, so runs of
bytes are the runs of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of a text that are split at once
PIECE = 1 << 22


def table(digits: bool) -> bytes:
    """What each byte becomes: itself or its small letter within terms, else a space."""
    letters = range(ord("a"), ord("z") + 1)
    keep = {*letters, *(range(ord("0"), ord("9") + 1) if digits else ()), *range(0x80, 0x100)}
    return bytes(b + 32 if b + 32 in letters and b < 0x60 else b if b in keep else 32 for b in range(256))


def folded(column: pa.Array, map_to: bytes) -> Iterator[bytes]:
    """The bytes of each text, with spaces around terms; null is empty."""
    for text in column.cast(pa.binary()):
        value = text.as_py()
        yield value.translate(map_to) if value else b""


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text in order, in lists of bounded size but for a term longer than that."""
    at, end = 0, len(text)
    while at < end:
        stop = end
        if end - at > PIECE:
            stop = text.rfind(b" ", at + 1, at + PIECE)
            if stop < 0:
                stop = text.find(b" ", at + PIECE)
                stop = end if stop < 0 else stop
        words = text[at:stop].split()
        if words:
            yield words
        at = stop


def lengths(column: pa.Array, map_to: bytes) -> np.ndarray:
    """The number of terms of each text; null has none."""
    out = np.zeros(len(column), np.int64)
    for i, text in enumerate(folded(column, map_to)):
        if text:
            inside = np.frombuffer(text, np.uint8) != 32
            out[i] = np.count_nonzero(inside[1:] & ~inside[:-1]) + int(inside[0])
    return out
