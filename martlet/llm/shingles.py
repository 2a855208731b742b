"""Hashed word shingles of many texts at once, in Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled together in a task.
PART_BYTES = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Tables over bytes: all blanks become spaces, and A-Z lower case.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[9:14] = 32
_LOWER = _BLANK.copy()
_LOWER[65:91] += 32


def parts(batch: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice) of an array in slices of about ``size`` bytes."""
    upto = pc.cumulative_sum(pc.binary_length(batch).cast("int64").fill_null(0)).to_numpy(zero_copy_only=False)
    cuts = [0, *(1 + np.flatnonzero(np.diff(upto // size))).tolist(), len(batch)]
    return ((i, batch.slice(i, j - i)) for i, j in zip(cuts, cuts[1:]) if j > i)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts (A-Z in lower case), and where each text begins."""
    strings = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    _, offsets, data = strings.buffers()
    table = _LOWER if lower else _BLANK
    data = pa.py_buffer(table[np.frombuffer(data, np.uint8)]) if data and data.size else pa.py_buffer(b"")
    lists = pc.split_pattern(pa.LargeStringArray.from_buffers(len(strings), offsets, data, offset=strings.offset), " ")
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    upto = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return table[coded.indices.to_numpy()[full]] if len(words) else np.zeros(0, np.uint64), upto[offsets - offsets[0]]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, whatever text they belong to."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _MIX + words[i : i + n]
    return mixed(h)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes; with fewer words one hash of all, without words none."""
    words, begins = word_hashes(texts)
    hashes = window_hashes(words, k)
    out = []
    for i, j in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if j - i >= k:
            out.append(np.unique(hashes[i : j - k + 1]))
        elif j > i:
            out.append(window_hashes(words[i:j], j - i) ^ np.uint64(j - i))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
