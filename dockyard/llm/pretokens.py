"""Pre-tokens in tasks: vectorised splitting, codes, and a cache from pre-token to what an encoder says of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

from dockyard.llm.words import BLOCK_BYTES, hash_spans

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

#: Code points with the White_Space property; fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of every code point, made once per process."""
    if not _classes:
        import unicodedata

        table = np.full(0x110000, OTHER, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        for cp in range(0x110000):
            kind = kinds.get(unicodedata.category(chr(cp))[0])
            if kind is not None:
                table[cp] = kind
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


class Block:
    """Some texts as one array of code points and one of UTF-8 bytes."""

    def __init__(self, texts: list[str]):
        self.cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.data = np.frombuffer("".join(texts).encode(), np.uint8)
        self.borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        if len(self.data) == len(self.cps):
            self.places = None
        else:
            sizes = 1 + (self.cps >= 0x80).astype(np.int8) + (self.cps >= 0x800) + (self.cps >= 0x10000)
            self.places = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def first(self) -> np.ndarray:
        """Marks where texts begin."""
        first = np.zeros(len(self.cps), bool)
        at = self.borders[:-1]
        first[at[at < len(self.cps)]] = True
        return first

    def pieces(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the pieces that begin where ``start`` is set, their byte ranges, and where each text's pieces begin."""
        begins = np.flatnonzero(start)
        bounds = np.searchsorted(begins, self.borders)
        lo = begins if self.places is None else self.places[begins]
        hi = np.append(lo[1:], len(self.data)) if len(lo) else lo
        return hash_spans(self.data, lo, hi), lo, hi, bounds


def blocks(texts: Sequence[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Block, list[str]]]:
    """Consecutive whole texts, some ``limit`` characters at a time, with the first one's place."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield first, Block(held), held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, Block(held), held


def byte_level_starts(block: Block) -> np.ndarray:
    """Where matches of the byte-level BPE pattern begin.

    Runs of letters, numbers or other visible characters are matches, with one blank (U+0020) before them; other
    white space is a match up to its last character where something visible follows. An apostrophe that begins a match
    takes s, t, m, d, re, ve or ll behind it.
    """
    cps, first = block.cps, block.first()
    n = len(cps)
    if not n:
        return first
    kind = char_classes()[cps]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    behind = np.flatnonzero(start[1:] & ~first[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[behind - 1] = True
    start[behind[cps[behind - 1] == 0x20]] = False
    mark = np.flatnonzero(start & (cps == 0x27))
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1] & (kind[mark + 1] == LETTER)]
    if len(mark):
        one = cps[mark + 1]
        third = np.minimum(mark + 2, n - 1)
        two = np.where((mark + 2 < n) & ~first[third], cps[third], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for at, size in ((mark[short], 2), (mark[long], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    return start


def same_bytes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the ranges lo to hi of ``data`` hold what the ranges first to last of ``other`` hold; no range is empty."""
    sizes = hi - lo
    same = sizes == last - first
    some = np.flatnonzero(same)
    if len(some):
        sizes = sizes[some]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        at = np.arange(ends[-1])
        differs = data[np.repeat(lo[some] - begins, sizes) + at] != other[np.repeat(first[some] - begins, sizes) + at]
        same[some] = np.add.reduceat(differs, begins) == 0
    return same


class Cache:
    """What an encoder gives for each piece (a row of numbers), kept by the piece's code; forgotten when full.

    A code only finds a row: what counts is that the bytes are the same. A piece whose code belongs to another one is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1 << 20):
        """``encode`` gives all pieces' numbers in a row and how many each has."""
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.codes = np.zeros(0, np.uint64)  # sorted
        self.rows = np.zeros(0, np.int64)  # the row of each code
        self.flat = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)  # where rows begin in flat
        self.raw = np.zeros(0, np.uint8)  # the pieces' bytes, row by row
        self.ends = np.zeros(1, np.int64)  # where rows begin in raw

    def look(self, data: np.ndarray, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The row of each piece; unknown pieces are encoded, each once."""
        distinct, at, back = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.codes) + len(distinct) > self.most:
            self.clear()
        place = np.searchsorted(self.codes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.codes)
        known[inside] = self.codes[place[inside]] == distinct[inside]
        new = at[~known]
        if len(new):
            rows = self._encoded(data, lo[new], hi[new])
            codes = np.concatenate((self.codes, distinct[~known]))
            order = np.argsort(codes, kind="stable")
            self.codes, self.rows = codes[order], np.concatenate((self.rows, rows))[order]
            place = np.searchsorted(self.codes, distinct)
        rows = self.rows[place][back]
        other = np.flatnonzero(~same_bytes(data, lo, hi, self.raw, self.ends[rows], self.ends[rows + 1]))
        if len(other):
            rows[other] = self._encoded(data, lo[other], hi[other])
        return rows

    def _encoded(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """New rows for these pieces."""
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        flat, sizes = self.encode(pieces)
        rows = len(self.starts) - 1 + np.arange(len(pieces))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, flat))
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(pieces), np.uint8)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(hi - lo)))
        return rows

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after the other, and where each row's begin (len + 1 entries)."""
        return gather(self.flat, self.starts, rows)


def gather(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = starts[rows + 1] - starts[rows]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends
