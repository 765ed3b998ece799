"""Vectorised word hashing for tasks: whole texts in, numpy arrays out.

A word is a maximal run of characters other than space and U+0009 to U+000D; A-Z are lower-cased,
nothing else. A word's code is the sum of one random 64-bit number per (byte, place in the word), finished by a mixer:
no algebra of powers links the places, so words that differ have codes that differ but for a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text hashed at once; a longer text makes a block of its own, so memory follows the longest text.
BLOCK_BYTES = 1 << 21
_MASK = (1 << 64) - 1

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64, so that every bit depends on every other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Numbers for the 256 bytes at each of 64 places; a byte further on takes the number of its place modulo 64, mixed with the rest.
PLACES = 64
_NUMBERS = mix(mix(np.arange(1, 256 * PLACES + 1, dtype=np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


def blocks(texts: Sequence[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8 (null: empty), some ``limit`` bytes at a time, with the first one's place."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def spans(raws: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's bytes, the words' starts and ends in them, and where each text's words begin (len + 1 entries)."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    blank = _BLANK[data]
    before = np.concatenate(([True], blank[:-1]))
    starts = np.flatnonzero(before & ~blank)
    ends = np.flatnonzero(~before & blank)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return data, starts, ends, bounds


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of the byte ranges (in order, not overlapping), the same for the same bytes anywhere."""
    n = len(data)
    begin = np.zeros(n, np.int32)
    begin[starts] = starts
    place = np.arange(n, dtype=np.int32)
    place -= np.maximum.accumulate(begin)
    values = _NUMBERS[((place & (PLACES - 1)) << 8) | data]
    # Bytes behind a blank count on from the word before; they are in no range.
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_codes(raws: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of a block in order, and where each text's begin (len + 1 entries)."""
    data, starts, ends, bounds = spans(raws, lower)
    return hash_spans(data, starts, ends), bounds


_PLACE = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def ngram_codes(words: np.ndarray, n: int) -> np.ndarray:
    """Codes of all n consecutive words; entry i starts at word i (text borders are the caller's)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACE[k]
    return mix(total)


def shingle_sets(raws: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct n-word shingle codes; the whole sequence is one where words are fewer than n."""
    words, bounds = word_codes(raws)
    grams = ngram_codes(words, n)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            short = words[lo:hi]
            out.append(mix(np.array([int((short * _PLACE[: hi - lo]).sum()) + (hi - lo) & _MASK], np.uint64)))
        else:
            out.append(words[:0])
    return out
