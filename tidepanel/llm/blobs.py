"""Counting hashed keys across blocks of documents with columnar exchanges.

A block of documents sorts its 64-bit keys and sends each range of the key space one binary
row; the task of a range sees that range of all blocks. Where rows per key would cost a
shuffle record each, this costs a few bytes. Ranges are equal shares of the hash space, so a
frequent key takes one entry per block, not one per occurrence.
"""

from __future__ import annotations

import numpy as np
import zstandard


def range_edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Positions in sorted ``keys`` where each range starts; ``ranges + 1`` entries."""
    firsts = [-(-(r << 64) // ranges) for r in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(firsts, np.uint64)), [len(keys)]]).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, the low one first."""
    v = np.ascontiguousarray(values, "<u4")
    planes = v.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()
