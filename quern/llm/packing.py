"""Numpy arrays in binary columns: many rows' worth of numbers in one row, so that an exchange moves few, large rows."""

from __future__ import annotations

import numpy as np
import zstandard

U = np.uint64


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in few bytes: integers as narrow as they may be (64-bit unsigned ones as they are), all compressed."""
    out = []
    for x in arrays:
        if isinstance(x, np.ndarray) and x.dtype.kind in "iu" and x.dtype != U:
            top = int(x.max()) if x.size else 0
            x = x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        kind = x.dtype.str.encode() if isinstance(x, np.ndarray) else b"raw"
        data = x.tobytes() if isinstance(x, np.ndarray) else x
        out += [len(kind).to_bytes(1, "little"), kind, len(data).to_bytes(8, "little"), data]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray | bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n = data[at]
        kind = data[at + 1 : at + 1 + n].decode()
        at += 1 + n
        size = int.from_bytes(data[at : at + 8], "little")
        at += 8
        out.append(data[at : at + size] if kind == "raw" else np.frombuffer(data, np.dtype(kind), size // np.dtype(kind).itemsize, at))
        at += size
    return out


def trim() -> None:
    """Gives freed memory back to the system: workers live on, and several share an executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
