"""Words and rolling word windows of many texts at once, as arrays of 64-bit hashes.

Words are runs of bytes other than the six ASCII blanks, so they are found in UTF-8 without decoding. A word's
hash is a polynomial over its bytes, a window's one over its words' hashes, both modulo 2 ** 64 with odd bases
and followed by a mixing step; prefix sums give every window in a few passes over the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n; kept for the next call unless very long."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        known = both[0], both[1]
        if size <= 1 << 23:
            _powers[base] = known
    return known


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans ascend and do not overlap."""
    return span_hashes_to(data, starts, [ends])[0]


def span_hashes_to(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of spans from each start to several ends, of which the first are the last; ends before a start give anything."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    at = 0
    while at < len(starts):  # spans that start in one block of bytes
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        low, high = int(starts[at]), int(ends[0][end - 1])
        up, down = powers(_BYTE_BASE, high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[data[low:high]] * up[: high - low], out=sums[1:])
        s = starts[at:end] - low
        for hashes, to in zip(out, ends, strict=True):
            hashes[at:end] = mix((sums[np.clip(to[at:end] - low, 0, high - low)] - sums[s]) * down[s])
        at = end
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): the spans of different bytes, and for each span which of these it is. Spans ascend, are not empty.

    Spans of equal hash are compared byte by byte; should any differ, all are told apart by their bytes.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, like = ends - starts, first[of]
    same = sizes == sizes[like]
    if same.all():
        shift = np.repeat(starts - starts[like], sizes)
        at = np.arange(len(shift)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        if (data[at] == data[at - shift]).all():
            return first, of
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    of = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(of, return_index=True)[1], of


class Words:
    """The words of some texts: starts, ends (in bytes), first (each text's first word), counts, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        self.data = _LOWER[data] if lower else data
        inside = ~_BLANK[self.data]
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            stops[:-1] &= ~inside[1:]
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            begins[cuts] = inside[cuts]  # a text begins and ends its words
            stops[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.hashes = span_hashes(self.data, self.starts, self.ends) if hashed else None

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of so many words within one text."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = powers(_WORD_BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        good = np.ones(n - size + 1, bool)
        for f in self.first[1:-1]:  # windows over the end of a text
            good[max(0, f - size + 1) : f] = False
        at = np.flatnonzero(good)
        return at, mix((sums[at + size] - sums[at]) * down[at])

    def begins(self, size: int) -> np.ndarray:
        """Of each word whether a window of so many words within one text begins there."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return left >= size

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bytes, starts, ends): all words with one space after each, and where each is among them."""
        sizes = self.ends - self.starts
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[starts + sizes] = False
        out[inside] = self.data[~_BLANK[self.data]]
        return out.tobytes(), starts, starts + sizes

    def whole(self, text: int) -> np.ndarray:
        """The hash of all words of one text as a single window."""
        h = self.hashes[self.first[text] : self.first[text + 1]]
        up, _ = powers(_WORD_BASE, len(h))
        return mix(np.array([(h * up[: len(h)]).sum(dtype=np.uint64)], np.uint64))

    def bytes_of(self, first: int, count: int) -> bytes:
        """So many words from a given one, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first : first + count], self.ends[first : first + count], strict=True))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, offsets from 0."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): the batches in slices of about max_bytes of text, a longer text alone."""
    for b in batches:
        _, offsets = string_buffers(b.column(text_at))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            part = b.slice(at, end - at)
            yield part, *string_buffers(part.column(text_at))
            at = end
