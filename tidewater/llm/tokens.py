"""Words of whole Arrow batches as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED, _ONE, _TWO = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _TWO
    return h ^ (h >> np.uint64(29))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (int64) of the lower-cased (A-Z) words of the texts, in order, and how many each text has. Null: empty.

    Words are what stands between ASCII blanks. Eight bytes are taken at a time, from all words that have them.
    """
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n = int(offsets[-1] - offsets[0])
    if not n:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low = np.zeros(n + 8, np.uint8)
    low[:n] = raw + (((raw - np.uint8(65)) < 26).view(np.uint8) << 5)
    word = (raw != 32) & ((raw - np.uint8(9)) >= 5)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = word[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = word[edge]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    counts = np.diff(np.searchsorted(start, offsets))
    turns = (size + 7) >> 3
    most = int(turns.max(initial=0))
    order = np.argsort((most - turns).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")
    start, size, turns = start[order], size[order], turns[order]
    eight = np.ndarray(buffer=low, dtype="<u8", shape=(n + 1,), strides=(1,))
    h = size.astype(np.uint64) * _ONE + _SEED
    for k in range(most):
        now = int(np.searchsorted(-turns, -k, "left"))
        v = eight[start[:now] + 8 * k] & _MASK[np.minimum(size[:now] - 8 * k, 8)]
        h[:now] = _mix((h[:now] ^ _mix(v * _ONE + np.uint64(k))) * _ONE)
    out = np.empty(len(h), np.int64)
    out[order] = h.view(np.int64)
    return out, counts


class Lookup:
    """Places of hashes in a sorted table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """-1: not in the table."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1)


def with_ends(values: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of words with an `end` behind each text, and the text of each."""
    row = np.repeat(np.arange(len(counts)), counts + 1)
    out = np.full(len(row), end, values.dtype)
    words = np.ones(len(row), bool)
    words[np.cumsum(counts + 1) - 1] = False
    out[words] = values
    return out, row


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))
