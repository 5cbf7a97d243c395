"""Tokens of whole texts as 64-bit fingerprints, cut and hashed by whole batches of UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; a longer text is a part of its own.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kinds() -> np.ndarray:
    kinds = np.full(256, 2, np.uint8)
    kinds[: 0x21] = kinds[0x7F] = 0
    kinds[0x80:] = 1
    for lo, hi in (("0", "9"), ("A", "Z"), ("a", "z")):
        kinds[ord(lo) : ord(hi) + 1] = 1
    return kinds


#: Of each byte: 0 space or control, 1 word (ASCII letters and digits, and all beyond ASCII), 2 other marks.
KINDS = _kinds()
#: Only words count as tokens.
WORDS = np.where(KINDS == 1, 1, 0).astype(np.uint8)
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: A number for each byte, as it stands and with A-Z in lower case.
EXACT = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
FOLDED = EXACT[_FOLD.astype(np.int64)]

_powers = {"of": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        run = np.full(max(n, PART + 1), base, np.uint64)
        run[0] = 1
        _powers[name] = np.multiply.accumulate(run)
    return _powers[name][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets of each; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    own = pc.fill_null(texts.cast(pa.binary()), b"")
    cuts = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64) if len(own) else np.zeros(1, np.int64)
    data = own.buffers()[2]
    blob = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return blob[cuts[0] : cuts[-1]], cuts - cuts[0]


def fingerprints(texts: pa.Array, kinds: np.ndarray = WORDS, table: np.ndarray = FOLDED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of the batch: the number of the first text, tokens in order as fingerprints, and each text's number of tokens.

    Tokens are the longest runs of bytes of one kind but 0; none reaches over the end of a text.
    """
    blob, cuts = buffers(texts)
    first = 0
    while first < len(cuts) - 1:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + PART, "right")) - 1)
        own, at = blob[cuts[first] : cuts[last]], cuts[first : last + 1] - cuts[first]
        n = len(own)
        kind = kinds[own]
        edge = np.ones(n + 1, bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[at] = True
        begin = np.flatnonzero(edge[:n] & (kind > 0))
        end = np.flatnonzero(edge[1:] & (kind > 0)) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[own] * _power("of", _BASE, n), out=sums[1:])
        prints = mixed((sums[end] - sums[begin]) * _power("back", _BACK, n + 1)[begin] + (end - begin).astype(np.uint64))
        yield first, prints, np.diff(np.searchsorted(begin, at))
        first = last
