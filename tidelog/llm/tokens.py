"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers in series, both compiled from the tokenizer file:

* the splitter walks character classes and marks where pieces begin. Its table is small and closed, so a text is cut in
  chunks of equal length, each chunk gives a map from states to states, and the maps compose by a parallel prefix scan.
  Then every chunk knows its first state and all chunks run side by side;
* the merger walks the bytes of one piece. A state keeps what later bytes can still depend on: the node of the trie of
  token prefixes reached by the longest suffix, and the last token and relative count of the best cover of each prefix
  within that suffix. Every transition carries the change in emitted tokens. States are compiled when first met and
  kept up to a bound, as there are too many to list.

Results: null text counts as empty, and an empty text has 0 tokens. Rows stay as they are, repeated ones too. Special
strings in a text are one token each, as the library counts them by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, pieces

#: Characters of a chunk of the splitter.
CHUNK = 128
#: States of the merger and counted pieces that a worker keeps before it starts anew.
MAX_STATES, MAX_PIECES = 200_000, 400_000

# Classes of the splitter: those of `pieces`, then the apostrophe, the letters that follow one, and the end of a stretch.
APOS, STMD, R, V, LL, E, END = 5, 6, 7, 8, 9, 10, 11
N_CLASSES = 12
(START, S1, W1, S2, W2, IN_L, IN_N, IN_P, AT_A, A_R, A_V, A_L, DONE) = range(13)
N_STATES = 13


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state * N_CLASSES + class. Output bit 1: a piece begins here; bit 2: one began at the character before."""
    step = np.zeros(N_STATES * N_CLASSES, np.uint8)
    out = np.zeros_like(step)
    letters = (pieces.L, STMD, R, V, LL, E)
    run = {**dict.fromkeys(letters, IN_L), pieces.N: IN_N, pieces.P: IN_P, APOS: AT_A}
    for s in range(N_STATES):
        spaces = s in (S1, W1, S2, W2)
        for c in range(N_CLASSES):
            k = s * N_CLASSES + c
            late = 2 * (s in (A_R, A_V, A_L))  # the letter after the apostrophe was no contraction's
            if c == END:
                step[k], out[k] = START, late
            elif c in (pieces.SP, pieces.WS):
                step[k] = (S2 if c == pieces.SP else W2) if spaces else (S1 if c == pieces.SP else W1)
                out[k] = 0 if spaces else 1 | late
            elif spaces:
                joins = s in (S1, S2)  # a space goes with what follows
                step[k] = IN_P if joins and c == APOS else run[c]
                out[k] = (0 if joins else 1) | (2 if s in (S2, W2) else 0)
            elif s in (START, DONE):
                step[k], out[k] = run[c], 1
            elif s == AT_A and c in (STMD, R, V, LL):
                step[k] = {STMD: DONE, R: A_R, V: A_V, LL: A_L}[c]
            elif s == AT_A and c in (pieces.P, APOS):
                step[k] = IN_P
            elif (s in (A_R, A_V) and c == E) or (s == A_L and c == LL):
                step[k] = DONE
            else:
                inside = IN_L if late else IN_P if s == AT_A else s
                same = inside == (IN_P if c == APOS else run[c])
                step[k], out[k] = inside if same else run[c], (0 if same else 1) | late
    return step, out


STEP, OUT = compile_splitter()


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """The first state of each chunk, from START, by composing all chunks' maps in log2 rounds (Hillis and Steele)."""
    done = maps.copy()
    k = 1
    while k < len(done):
        done[k:] = np.take_along_axis(done[k:], done[:-k].copy(), 1)  # earlier map first
        k *= 2
    first = np.full(len(maps), START, np.uint8)
    first[1:] = done[:-1, START]
    return first


def split(symbols: np.ndarray) -> np.ndarray:
    """Where pieces begin in a run of splitter classes that ends with END."""
    n = len(symbols)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for j in range(CHUNK):
        maps = STEP[maps * np.uint8(N_CLASSES) + grid[j][:, None]]
    state = scan_maps(maps)
    marks = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        k = state * np.uint8(N_CLASSES) + grid[j]
        marks[j] = OUT[k]
        state = STEP[k]
    marks = marks.T.reshape(-1)[:n]
    begin = (marks & 1).astype(bool)
    begin[:-1] |= (marks[1:] & 2).astype(bool)
    return np.flatnonzero(begin)


class Merger:
    """The merging transducer: bytes of a piece in, number of tokens out."""

    def __init__(self, spec: dict) -> None:
        unit = _byte_units()
        vocab = {bytes(unit[c] for c in text): i for text, i in spec["vocab"].items()}
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["merges"]):
            a, b = (bytes(unit[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = (r, z)
            self.halves[z] = (r, x, y)
        self._trie(vocab)
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.reset()

    def _trie(self, vocab: dict[bytes, int]) -> None:
        """Nodes are prefixes of tokens; `fall` goes to the longest proper suffix that is one as well."""
        self.kids: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for text, i in vocab.items():
            at = 0
            for b in text:
                if b not in self.kids[at]:
                    self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.depth.append(self.depth[at] + 1)
                    self.token.append(-1)
                at = self.kids[at][b]
            self.token[at] = i
        self.fall = [0] * len(self.kids)
        level = list(self.kids[0].values())
        while level:
            below = []
            for at in level:
                for b, kid in self.kids[at].items():
                    f = self.fall[at]
                    while f and b not in self.kids[f]:
                        f = self.fall[f]
                    self.fall[kid] = self.kids[f].get(b, 0)
                    below.append(kid)
            level = below

    def reset(self) -> None:
        """Forget compiled states. State 0: nothing read."""
        self.states: list[tuple[int, tuple, tuple]] = [(0, (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.fits_memo.clear()

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between these two neighbouring tokens.

        Undo the later of both tokens' merges until bytes remain. A pair that meets at the border would have merged if
        its rank came before the merges that took one of its parts away.
        """
        found = self.fits_memo.get((left, right))
        if found is not None:
            return found
        a, b = left, right
        # The parts are consumed at these ranks; a tie in rank goes to what stands further left.
        until_a = until_b = 1 << 60
        ok = True
        while True:
            pair = self.rank.get((a, b))
            if pair and pair[0] < until_a and pair[0] <= until_b and not (pair[0] == until_b == until_a):
                ok = False
                break
            ra, rb = self.halves.get(a, (-1,))[0], self.halves.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                break
            if ra >= rb:
                until_a, a = ra, self.halves[a][2]
            else:
                until_b, b = rb, self.halves[b][1]
        self.fits_memo[left, right] = ok
        return ok

    def _ends(self, node: int) -> list[tuple[int, int]]:
        """The tokens that end here with their lengths, longest first."""
        got = self.ends.get(node)
        if got is None:
            got, f = [], node
            while f:
                if self.token[f] >= 0:
                    got.append((self.token[f], self.depth[f]))
                f = self.fall[f]
            self.ends[node] = got
        return got

    def _compile(self, at: int, b: int) -> tuple[int, int]:
        node, last, count = self.states[at]
        while node and b not in self.kids[node]:
            node = self.fall[node]
        node = self.kids[node].get(b, 0)
        keep = self.depth[node]  # the new suffix has so many bytes; prefixes that end before it don't matter
        for t, size in self._ends(node):
            before = last[-size]  # the last token of the prefix before it, -1 at the piece's beginning
            if before < 0 or self.fits(before, t):
                break
        delta = count[-size] + 1  # relative to the count before this byte
        last = (*last, t)[-(keep + 1) :]
        count = (*(c - delta for c in count), 0)[-(keep + 1) :]
        key = (node, last, count)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[at << 8 | b] = got = (to, delta)
        return got

    def count(self, piece: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        at = total = 0
        get = self.moves.get
        for b in piece:
            got = get(at << 8 | b) or self._compile(at, b)
            at = got[0]
            total += got[1]
        return total


def _byte_units() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Counts the tokens of Arrow columns of texts, by one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.classes = pieces.Classes(Tokenizer.from_file(path))
        self.merger = Merger(spec["model"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        #: Splitter symbols of the classes; ASCII characters that contractions need stand apart.
        self.fine = {0x27: APOS, **{ord(c): STMD for c in "stmd"}, ord("r"): R, ord("v"): V, ord("l"): LL, ord("e"): E}
        self.classes.of(np.arange(128, dtype=np.uint32))
        for cp, c in self.fine.items():
            self.classes.table[cp] = c

    def _sizes(self, distinct: list[bytes]) -> np.ndarray:
        if len(self.known) > MAX_PIECES:
            self.old, self.known = self.known, {}  # pieces still in use come back from `old`
        known, old, count = self.known, self.old, self.merger.count
        got = list(map(known.get, distinct))
        for i, n in enumerate(got):
            if n is None:
                n = old.get(distinct[i])
                got[i] = n = count(distinct[i]) if n is None else n
                if len(distinct[i]) <= 64:
                    known[distinct[i]] = n
        return np.array(got, np.int64)

    def counts(self, column: pa.Array) -> np.ndarray:
        batch = pieces.Batch(column)
        symbols = self.classes.of(batch.cps)
        # An END goes over each special string, and before each document.
        skip = np.zeros(len(symbols), bool)
        extra = np.zeros(len(column), np.int64)
        cut = np.zeros(len(symbols) + 1, bool)
        cut[batch.starts[:-1]] = True
        for content in self.special:
            found = batch.special(content)
            for at in found:
                skip[at : at + len(content)] = True
            np.add.at(extra, np.searchsorted(batch.starts, found, "right") - 1, 1)
            cut[found] = cut[found + len(content)] = True
        symbols[skip] = END
        starts = batch.starts[:-1][np.diff(batch.starts) > 0]
        with_ends = np.insert(symbols, starts, END)
        with_ends = np.append(with_ends, np.uint8(END))
        begin = split(with_ends)
        shift = np.zeros(len(with_ends) + 1, np.int32)
        shift[starts + np.arange(1, len(starts) + 1)] = 1
        begin -= np.cumsum(shift)[begin]
        cut[begin] = True
        cuts = np.flatnonzero(cut[:-1])
        if not len(cuts):
            return extra
        encoded = batch.pieces(cuts).dictionary_encode()
        sizes = self._sizes(encoded.dictionary.to_pylist())[encoded.indices.to_numpy()]
        sizes[skip[cuts]] = 0
        total = np.append(0, np.cumsum(sizes))
        at = np.searchsorted(cuts, batch.starts)
        return total[at[1:]] - total[at[:-1]] + extra


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit, replacing columns of those names.

    tokenizer: name of a byte-level BPE file among the public tokenizers, found on each executor.
    """
    common.small_batches(docs.sparkSession)
    slim = docs.drop("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in slim.columns if c != text]
    slim = slim.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = slim.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        work = counter(public_tokenizers.path(tokenizer))
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n = work.counts(texts)
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    import pyarrow.compute  # noqa: F401

    return slim.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, "byte_bpe_50k.json")
