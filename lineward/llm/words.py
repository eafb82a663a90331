"""Words of many texts at once: array arithmetic over the bytes of an Arrow text column.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D. Letters A to Z are taken as lower
case. Every word gets a 64-bit hash that depends on its bytes only, not on its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACES = b"\t\n\x0b\x0c\r "
# Most bytes of text that are turned into arrays at once; a single longer text is taken alone.
BLOCK_BYTES = 1 << 20
# The same for the stages that hold many numbers for each byte; a worker keeps what its largest block took.
HASHED_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class Block(NamedTuple):
    """Some consecutive texts of a batch.

    ``first`` is the row of the batch the block begins at, ``rows`` their number; ``data`` the bytes,
    ``bounds`` where each text begins and the last one ends; ``start`` and ``end`` bound each word,
    ``doc`` is the text of each word, ``words`` the number of words of each text.
    """

    first: int
    rows: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    words: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the splitmix64 finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_table() -> np.ndarray:
    """For each byte the byte that stands for it in a hash: A to Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def codes_of(table: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte, the same for bytes that ``table`` makes equal."""
    return mixed((table.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in blocks of bounded size, with the bounds of their words."""
    data, bounds = text_bytes(column)
    separator = np.zeros(256, bool)
    separator[list(SPACES)] = True
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), rows)
        part = data[bounds[first] : bounds[last]]
        cuts = bounds[first : last + 1] - bounds[first]
        inside = ~separator[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = cuts[:-1][cuts[:-1] < len(part)]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = cuts[1:][cuts[1:] > 0] - 1
        ends[edge] = inside[edge]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        doc = np.searchsorted(cuts, start, "right") - 1
        yield Block(
            first, last - first, part, cuts, start, end, doc, np.bincount(doc, minlength=last - first)
        )
        first = last


class Hasher:
    """Hashes of byte ranges of a block; tables of powers are kept between blocks."""

    def __init__(self, table: np.ndarray | None = None):
        self.codes = codes_of(lower_table() if table is None else table)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, length: int) -> None:
        if len(self.powers) <= length:
            factors = np.full(length + 1, _BASE, np.uint64)
            factors[0] = 1
            self.powers = np.cumprod(factors)
            factors[1:] = _BASE_INVERSE
            self.inverses = np.cumprod(factors)

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of ``data[start:end]`` for each pair of bounds."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.inverses[start])

    def words(self, block: Block) -> np.ndarray:
        return self.ranges(block.data, block.start, block.end)

    def runs(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each sequence ``hashes[start:end]``, whatever its place."""
        self._grow(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` consecutive word hashes; the run at i begins at word i."""
    count = max(len(hashes) - length + 1, 0)
    out = np.full(count, length, np.uint64)
    for i in range(length):
        out = mixed(out * np.uint64(_BASE) + hashes[i : i + count])
    return out


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (text, value): whether its text has it twice or more, and whether it stands there earlier."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
    more = again.copy()
    more[:-1] |= again[1:]
    twice, earlier = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    twice[order], earlier[order] = more, again
    return twice, earlier


def same_text(doc: np.ndarray, length: int) -> np.ndarray:
    """Whether the run of ``length`` words that begins at each word ends in the same text."""
    count = max(len(doc) - length + 1, 0)
    return doc[:count] == doc[length - 1 : length - 1 + count]
