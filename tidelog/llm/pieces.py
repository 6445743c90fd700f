"""Cut texts into the pieces that a byte-level BPE tokenizer merges within.

Character classes are asked of the tokenizer file's own pre-tokenizer, code point by code point as they turn up, so
that no copy of Unicode tables can disagree with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SP, WS, L, N, P = range(5)
UNKNOWN = 255


class Classes:
    """Code point -> class (space, other white space, letter, number, rest)."""

    def __init__(self, tokenizer) -> None:
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.table[0x20] = SP

    def _probe(self, cps: np.ndarray) -> None:
        """Whether a character joins a letter, a digit or a sign before it tells its class."""
        for at in range(0, len(cps), 2000):
            part = cps[at : at + 2000]
            text = "".join(f"\na{chr(c)}\n1{chr(c)}\n!{chr(c)}" for c in part)
            starts = {a for _, (a, _) in self._split(text)}
            for i, c in enumerate(part):
                joined = [9 * i + 2 + 3 * k not in starts for k in range(3)]
                self.table[c] = L if joined[0] else N if joined[1] else P if joined[2] else WS

    def of(self, cps: np.ndarray) -> np.ndarray:
        got = self.table[cps]
        if (got == UNKNOWN).any():
            self._probe(np.unique(cps[got == UNKNOWN]))
            got = self.table[cps]
        return got


class Batch:
    """The texts of an Arrow column as one run of code points; nulls are empty."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
        self.byte_offsets = offsets - offsets[0]
        self.data = bytes(raw)
        self.cps = np.frombuffer(self.data.decode().encode("utf-32-le"), np.uint32)
        if len(self.cps) == len(self.data):
            self.byte_at = np.arange(len(self.cps) + 1, dtype=np.int64)
        else:
            width = np.ones(len(self.cps) + 1, np.int64)
            width[0] = 0
            for least in (0x80, 0x800, 0x10000):
                width[1:] += self.cps >= least
            self.byte_at = np.cumsum(width)
        #: Where each document begins, in code points; one more at the end.
        self.starts = np.searchsorted(self.byte_at, self.byte_offsets)

    def special(self, content: str) -> np.ndarray:
        """Where the text of a special token begins, in code points; never across two documents."""
        want, at, found = content.encode(), 0, []
        while (at := self.data.find(want, at)) >= 0:
            k = int(np.searchsorted(self.byte_offsets, at, "right")) - 1
            inside = at + len(want) <= self.byte_offsets[k + 1]
            if inside:
                found.append(at)
            at += len(want) if inside else 1
        return np.searchsorted(self.byte_at, np.array(found, np.int64))

    def pieces(self, cuts: np.ndarray) -> pa.Array:
        """The texts between neighbouring cuts (code points), without copying them."""
        bounds = np.append(self.byte_at[cuts], len(self.data))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(self.data)])


def vector_cuts(cps: np.ndarray, classes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Code points at which a piece begins, by comparing neighbours.

    `breaks`: sorted places where the rules start anew (documents, special tokens); a piece begins at each.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    breaks = breaks[breaks < n]
    fresh = np.zeros(n + 3, bool)
    fresh[breaks] = True
    fresh[n:] = True
    space = classes <= WS
    first = fresh[:n]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = WS, classes[:-1]
    last_of_run = np.empty(n, bool)
    last_of_run[-1], last_of_run[:-1] = False, ~space[1:] & ~first[1:]
    after_space = before <= WS
    begin = np.where(space, ~after_space | last_of_run, np.where(after_space, before == WS, before != classes)) | first
    for i in np.flatnonzero((cps == 0x27) & begin):
        a = chr(cps[i + 1]) if not fresh[i + 1] else ""
        b = chr(cps[i + 2]) if a and not fresh[i + 2] else ""
        long = 3 if a + b in ("re", "ve", "ll") else 2 if a and a in "stmd" else 0
        if long:
            begin[i + 1 : i + long] = False
            if i + long < n:
                begin[i + long] = True
    return np.flatnonzero(begin)
