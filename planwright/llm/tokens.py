"""Words of texts as 64-bit hashes, for the operators that count or compare words in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text: A-Z lower-cased, split at ASCII white space. (A table of the
    words seen so far would cost more than hashing them again.)"""
    words = text.lower().split()  # on bytes, both know ASCII only
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what is made of their texts stays small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
