"""Words of many texts as arrays, and sorted 64-bit keys as compact blocks of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: Odd 64-bit constants of the hash finaliser.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words:
    """The words of an array of texts: ids into `vocabulary`, and where each text starts in them."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        if lower:
            # before the cast: on a slice that was cast, it returns other bytes
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        starts = np.asarray(lists.offsets)
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate([[0], np.cumsum(np.asarray(real), dtype=np.int64)])
        self.starts = before[starts - starts[0]] if len(starts) else np.zeros(1, np.int64)
        self.flat = flat.filter(real)
        coded = self.flat.dictionary_encode()
        self.ids = np.asarray(coded.indices).astype(np.int64)
        self.vocabulary = coded.dictionary

    def __len__(self) -> int:
        return len(self.starts) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """XXH64 of each vocabulary word."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w.as_buffer(), seed) for w in self.vocabulary.cast(pa.large_binary())), np.uint64, len(self.vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every run of `width` values, by doubling."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    n, left, have, out = len(values) - width + 1, width, 0, np.uint64(0)
    # `part` hashes runs of `size` values
    part, size = values, 1
    while left:
        if left & 1:
            out = out + _power(base, have) * part[have:have + n]
            have += size
        left >>= 1
        if left:
            part = part[: len(part) - size] + _power(base, size) * part[size:]
            size *= 2
    return mix(out)


def _power(base: int, exponent: int) -> np.uint64:
    return np.uint64(pow(base, exponent, 1 << 64))


def squeeze(numbers: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes, the low bytes first."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys, kept as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of the 64-bit numbers starts and ends in rising keys."""
    limits = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
