"""Words of Arrow text columns as numpy arrays, without a Python object for each word.

A word is `[^\\x20\\x09-\\x0D]+` on the UTF-8 bytes. A word's hash is 64 bits: a polynomial over random values of its bytes, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time: the temporary arrays take about 40 times as much.
SEGMENT = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finalizer)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        steps = np.full(size, base % (1 << 64), U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and where each text begins (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _segments(data: np.ndarray, at: np.ndarray):
    """Pieces of about SEGMENT bytes that end at a text's end or after white space."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(begin + SEGMENT, n)
        if end < n:
            cut = int(at[np.searchsorted(at, end, "right") - 1])
            if cut <= begin:  # one text fills the piece
                stop = int(at[np.searchsorted(at, end)])
                while end < stop and not SPACE[data[end - 1]]:
                    end += 1
            else:
                end = cut
        yield begin, end
        begin = end


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in data; a word never goes over a text's end."""
    filled = ~SPACE[data]
    after = np.concatenate(([False], filled[:-1])) if len(filled) else filled.copy()
    inner = at[(at > 0) & (at < len(data))]
    after[inner] = False
    starts = np.flatnonzero(filled & ~after)
    before = np.concatenate((filled[1:], [False])) if len(filled) else filled.copy()
    before[inner - 1] = False
    return starts, np.flatnonzero(filled & ~before) + 1


def hashes(column: pa.Array | pa.ChunkedArray, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (one more for the end). folded: A-Z as a-z."""
    data, at = buffers(column)
    table, found, where = BYTE_FOLDED if folded else BYTE, [], []
    for begin, end in _segments(data, at):
        piece = data[begin:end]
        low, high = np.searchsorted(at, begin, "right"), np.searchsorted(at, end)
        starts, ends = spans(piece, at[low:high] - begin)
        sums = np.empty(len(piece) + 1, U)
        sums[0] = 0
        np.cumsum(table[piece] * powers(BASE, len(piece)), out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * powers(INVERSE, len(piece) + 1)[starts] + (ends - starts).astype(U)))
        where.append(starts + begin)
    if not found:
        return np.empty(0, U), np.zeros(len(at), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(where), at).astype(np.int64)


def rolling(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every `size` words in a row inside one text: the hashes, and the index of each window's first word.

    One window's hash comes from the one before: times the base, less the word that leaves, plus the word that comes. Modulo 2**64 with
    an odd base, all of them follow from one running sum.
    """
    n = len(words)
    if n < size:
        return np.empty(0, U), np.empty(0, np.int64)
    out, first = [], []
    step = 1 << 19
    ends = np.repeat(at[1:], np.diff(at))  # of the word's text
    for begin in range(0, n - size + 1, step):
        stop = min(begin + step, n - size + 1)
        part = words[begin : stop + size - 1]
        sums = np.empty(len(part) + 1, U)
        sums[0] = 0
        np.cumsum(part * powers(INVERSE, len(part)), out=sums[1:])
        k = stop - begin
        h = (sums[size : size + k] - sums[:k]) * powers(BASE, k)
        inside = np.flatnonzero(np.arange(begin, stop) + size <= ends[begin:stop])
        out.append(mix(h[inside]))
        first.append(inside + begin)
    return np.concatenate(out), np.concatenate(first)


def pieces(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """The batch in slices of at most `most` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = buffers(column)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
