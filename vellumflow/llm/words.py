"""Words of many texts at once, as 64-bit hashes, by array operations over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is a block of its own.
BLOCK = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a long word that are added up at a time, and powers of the multiplier for that many.
STRETCH = 1 << 18
_POWERS = np.full(STRETCH, _MULTIPLIER, np.uint64)
_POWERS[0] = 1
np.multiply.accumulate(_POWERS, out=_POWERS)
#: Words of more bytes than this are long. Others are hashed together, eight bytes at a time.
LONG_WORD = 1 << 10
#: By number of bytes up to eight, what is kept of eight bytes.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: list[bytes], size: int = BLOCK):
    """Slices of ``texts`` of about ``size`` bytes: (first, texts)."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, texts[first:i]
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def column_blocks(column: pa.Array, size: int = BLOCK, at: np.ndarray | None = None) -> Iterator[tuple[int, list]]:
    """(first, texts) for slices of a column, or of its rows ``at``, of about ``size`` bytes; only one slice is in memory as a list."""
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum((lengths if at is None else lengths[at]).astype(np.int64) + 1)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, side="right")))
        yield first, (column.slice(first, last - first) if at is None else column.take(pa.array(at[first:last]))).to_pylist()
        first = last


def hash_words(texts: list[bytes], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text number, start, the joined bytes) of the words: runs of bytes that are no separators.

    Equal words have equal hashes; of n distinct words about n*n/2**65 pairs share one by chance.
    """
    joined = b"\n".join((*texts, bytes(8)))  # so that eight bytes can be read at any place of a text
    data = np.frombuffer(joined, np.uint8)[: max(0, len(joined) - 9)]
    inside = np.zeros(len(data) + 2, bool)
    np.take(~separators, data, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    which = numbered(starts, np.cumsum(sizes)[:-1])
    if not len(starts):
        return np.empty(0, np.uint64), which, starts, data
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    hashes = mix((eight[starts] & _KEPT[np.minimum(left, 8)]) + left.astype(np.uint64) * np.uint64(_MULTIPLIER))
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        hashes[i] = mix(hashes[i : i + 1] + np.uint64(_word_sum(data[starts[i] : ends[i]])))[0]
    more, at = np.flatnonzero((left > 8) & (left <= LONG_WORD)), 8
    while len(more):
        hashes[more] = mix(hashes[more] + (eight[starts[more] + at] & _KEPT[np.minimum(left[more] - at, 8)]))
        at += 8
        more = more[left[more] > at]
    return hashes, which, starts, data


def numbered(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the sorted ``places`` how many of the sorted ``ends`` are at or before it."""
    cuts = np.concatenate(([0], np.searchsorted(places, ends), [len(places)]))
    return np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))


def _word_sum(word: np.ndarray) -> int:
    """Values of a word's bytes by powers of their place in it, added up; long words in pieces."""
    total, scale = 0, 1
    for first in range(0, len(word), len(_POWERS)):
        part = word[first : first + len(_POWERS)]
        total += scale * int((_VALUES[part] * _POWERS[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(_MULTIPLIER, len(part), 1 << 64) & 0xFFFFFFFFFFFFFFFF
    return total & 0xFFFFFFFFFFFFFFFF
