"""Vectorised word kernels over Arrow batches.

A *word* is a maximal run of letters and digits, case ignored; everything else, the underscore included,
separates words.  A batch becomes one flat array of 64-bit word hashes plus record offsets; only the distinct
words of a batch are hashed in Python, all else is numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEPARATORS = r"[^\p{L}\p{N}]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Of lower-case texts, the bytes of ASCII letters and digits and of all other characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def as_text(col: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def coded_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, number of each word among them, offsets of the records).

    Words are found byte by byte; texts with other letters than ASCII first get blanks for their separators.
    """
    if len(text) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    low = pc.utf8_lower(as_text(text))
    other = pc.invert(pc.string_is_ascii(low))
    if pc.any(other).as_py():
        low = pc.replace_with_mask(low, other, pc.replace_substring_regex(low.filter(other), pattern=SEPARATORS, replacement=" "))
    _, ends, data = low.buffers()
    ends = np.frombuffer(ends, np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = _IN_WORD[data]
    apart = np.ones(len(data) + 1, bool)  # whether a byte and the one before it are of different words
    apart[1:-1] = ~(inside[1:] & inside[:-1])
    apart[ends] = True
    first = np.flatnonzero(inside & apart[:-1])
    after = np.flatnonzero(inside & apart[1:]) + 1
    upto = np.concatenate([[0], np.cumsum(after - first)])
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(upto), pa.py_buffer(data[inside])])
    coded = found.dictionary_encode()
    entries = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(x) for x in entries), np.uint64, len(entries))
    return table, np.asarray(coded.indices).astype(np.int64), np.searchsorted(first, ends)


def hashed_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets): the words of record i are hashes[offsets[i]:offsets[i + 1]]."""
    table, codes, offsets = coded_words(text)
    return table[codes], offsets


def owners(offsets: np.ndarray) -> np.ndarray:
    """The record of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_record_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by record, wrapping as 64-bit integers."""
    upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def bag_ids(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each record's multiset of words; the order of words is of no account."""
    return per_record_sum(mix(words + _GOLD), offsets).view(np.int64)


def numbered_words(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each word's hash joined with its how-manieth occurrence in its record.

    The common elements of two such sets number the words that two records share, counted with repetition.
    The result is ordered by record.
    """
    rec = owners(offsets)
    order = np.lexsort((words, rec))
    w, r = words[order], rec[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(first)
    nth = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
    return mix(w + _GOLD * nth.astype(np.uint64)).view(np.int64)


def numbered_codes(codes: np.ndarray, distinct: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, how-manieth occurrence) of the words of each record, by record and code; see ``coded_words``."""
    base = owners(offsets) * distinct
    at = np.sort(base + codes)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), at[1:] != at[:-1]]))
    return at - base, np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))


def number(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Numbered words of their hashes and occurrences, as ``numbered_words``."""
    return mix(hashes + _GOLD * nth.astype(np.uint64)).view(np.int64)


def grams(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``size`` words from each word on, whether they all lie in one record)."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out[: n - k] = mix(out[: n - k] * np.uint64(3) + words[k:] + np.uint64(k + 1))
    rec_end = np.repeat(offsets[1:], np.diff(offsets))
    return out, np.arange(n) + size <= rec_end


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of flat ``values``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))
