"""Words of texts and their hashed character n-grams, in whole Arrow chunks.

A word is a run of letters (Unicode) of the lower-cased text; n-grams are taken over the UTF-8 bytes of
"<word>", so a misspelling shares most of them with the word that it comes from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word in them, words of each text); null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    lists = pc.split_pattern(pc.utf8_trim_whitespace(plain), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    if empty.any():
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts), weights=empty, minlength=len(counts)).astype(np.int64)
        words = words.filter(pa.array(~empty))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts


def ngrams(words: pa.Array, least: int, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, n-grams of each word), word by word."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    marked = pc.binary_join_element_wise("<", words.cast(pa.string()), ">", "").cast(pa.binary())
    offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    room = np.repeat((offsets[1:] - offsets[0]).astype(np.int32), sizes)  # bytes of the word from each byte on
    room -= np.arange(len(raw), dtype=np.int32)
    each = [np.maximum(0, sizes - size + 1) for size in range(least, most + 1)]
    grams = sum(each)
    places = np.cumsum(grams) - grams
    buckets, rolling = np.empty(int(grams.sum()), np.int32), np.zeros(len(raw), np.uint64)
    for size in range(1, most + 1):
        if len(raw) < size:
            break
        rolling = rolling[: len(raw) - size + 1]
        rolling *= np.uint64(1_000_003)
        rolling += raw[size - 1 :]
        rolling += np.uint64(1)
        if size >= least:
            mixed = rolling[room[: len(rolling)] >= size]
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MULTIPLIER
            mixed >>= np.uint64(64 - bits)
            own = each[size - least]
            buckets[ranges(places, own)] = mixed
            places = places + own
    return buckets, grams
