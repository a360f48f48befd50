"""Texts as columns of repeating units, for encoders that needn't see a unit twice.

A slice of documents is one UTF-8 buffer. Cutting it at white space is array
arithmetic over that buffer; the units are then dictionary-encoded, the few
distinct ones are encoded by the caller, and the encodings are gathered back in
text order. Memory is bounded by the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE = 8 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of SLICE bytes at most, or one longer text."""
    at = size = 0
    for n, t in enumerate(texts):
        if n > at and size + len(t) > SLICE:
            yield at, n
            at, size = n, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def unit_starts(data: np.ndarray, doc_starts: np.ndarray, glue: bool) -> np.ndarray:
    """Where units begin. glue: a last single blank of a run of white space belongs to the word after it.

    Units cover all of data. Each run of white space but for its last character
    is a unit, so is that character (unless glued), so is each word.
    """
    n = len(data)
    space = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    before = np.concatenate([[False], space[:-1]])
    start = first[:n] | (space & ~before)
    after_word = np.concatenate([~space[1:], [False]]) & ~first[1:]
    start |= space & after_word
    blank = np.concatenate([[False], data[:-1] == 32]) if glue else np.zeros(n, bool)
    start |= ~space & before & ~blank
    return np.flatnonzero(start)


class Encoded:
    """The units of a slice: codes into distinct units, and where each document's begin."""

    def __init__(self, texts: list[bytes], glue: bool, uncut: np.ndarray | None = None):
        """uncut: which texts are one unit each."""
        buffer = b"".join(texts)
        data = np.frombuffer(buffer, np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if len(data):
            at = unit_starts(data, starts[starts < len(data)], glue)
        else:
            at = np.zeros(0, np.int64)
        if uncut is not None and uncut.any():
            of = np.searchsorted(starts, at, side="right") - 1  # of empty texts at one place the last, which is the one with the bytes
            at = at[~uncut[of] | (at == starts[of])]
        wide = len(data) >= 1 << 31
        offsets = np.concatenate([at, [len(data)]]).astype(np.int64 if wide else np.int32)
        kind = pa.large_binary() if wide else pa.binary()
        units = pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
        coded = pc.dictionary_encode(units)
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.doc_at = np.searchsorted(at, np.concatenate([starts, [len(data)]]))

    def gather(self, by_unit: list[bytes]) -> tuple[memoryview, np.ndarray]:
        """The units' values in text order as one buffer, and each document's offsets in it."""
        sizes = np.fromiter(map(len, by_unit), np.int64, len(by_unit))
        offsets = np.concatenate([[0], np.cumsum(sizes[self.codes])]) if len(self.codes) else np.zeros(1, np.int64)
        values = pa.array(by_unit, pa.large_binary()).take(pa.array(self.codes)) if len(self.codes) else None
        buffer = memoryview(values.buffers()[2] or b"") if values is not None else memoryview(b"")
        return buffer, offsets[self.doc_at]

    def totals(self, by_unit: np.ndarray) -> np.ndarray:
        """The sum of the units' numbers for each document."""
        sums = np.concatenate([[0], np.cumsum(by_unit[self.codes])]) if len(self.codes) else np.zeros(1, np.int64)
        return sums[self.doc_at[1:]] - sums[self.doc_at[:-1]]
