"""Words of many texts at once, by numpy over their UTF-8 bytes: places, 64-bit codes, lines, paragraphs, and content-chosen probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from scrivane.llm.common import by_value

#: Bytes that are looked at together, and bytes of the texts of a slice, if it has more than one text.
BLOCK, SLICE = 1 << 18, 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD6E8FEB86659FD93
_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k below n."""
    known = _tables.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, 4096), base % 2**64, np.uint64)
        factors[0] = 1
        known = _tables[base] = np.cumprod(factors)
    return known[:n]


def backward(n: int) -> np.ndarray:
    return powers(n, pow(_BASE, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def in_a_row(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n codes in a row, few enough to be added one by one."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    by, size = powers(n), len(codes) - n + 1
    total = codes[:size] * by[0]
    for k in range(1, n):
        total += codes[k : k + size] * by[k]
    return mixed(total)


def rows_of(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n codes from each start."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=sums[1:])
    return mixed((sums[starts + n] - sums[starts]) * backward(len(codes) + 1)[starts])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have so many bytes in all, or one text each."""
    if not batch.num_rows:
        return
    ends = raw(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (and the last ends), without a copy."""
    wide = pa.types.is_large_string(column.type)
    places = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[places[0] : places[-1]] if held is not None and held.size else np.empty(0, np.uint8)
    return data, places - places[0]


def _coded(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unmixed code, start, end) of the words in a block; words don't reach over edges."""
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    first[edges] = ~space[edges]
    inner = edges[edges > 0] - 1
    last[inner] = ~space[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return (sums[ends] - sums[starts]) * backward(len(data) + 1)[starts], starts, ends


class Words:
    """The words of a slice's texts, one after the other. Equal words have equal codes; white space is [\\x20\\x09-\\x0D]."""

    def __init__(self, texts: pa.Array):
        self.data, self.edges = raw(texts)
        space = _SPACE[self.data]
        gaps, parts, at = np.flatnonzero(space) + 1, [], 0
        while at < len(self.data):  # blocks end after white space or with a text, or else within a word
            end = min(at + BLOCK, len(self.data))
            before = [int(x[k - 1]) for x in (gaps, self.edges) if (k := np.searchsorted(x, end, "right"))]
            end = max((x for x in before if x > at), default=end)
            inside = self.edges[np.searchsorted(self.edges, at) : np.searchsorted(self.edges, end)] - at
            codes, starts, ends = _coded(self.data[at:end], inside)
            starts, ends = starts + at, ends + at
            if parts and len(starts) and starts[0] == at and parts[-1][2][-1:].tolist() == [at] and at not in self.edges[np.searchsorted(self.edges, at) :][:1]:
                held = parts[-1]  # the rest of a word that the block before has begun
                with np.errstate(over="ignore"):
                    held[0][-1] += codes[0] * np.uint64(pow(_BASE, at - int(held[1][-1]), 2**64))
                held[2][-1] = ends[0]
                codes, starts, ends = codes[1:], starts[1:], ends[1:]
            if len(starts):
                parts.append((codes, starts, ends))
            at = end
        self.codes, self.starts, self.ends = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
        self.codes = mixed(self.codes)
        #: Where the words of each text begin, and the last end.
        self.bounds = np.searchsorted(self.starts, self.edges)
        self._points = None

    def points(self, places: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Bytes' places in the slice as code points' places in their texts."""
        if self._points is None:
            ascii_ = not self.data.size or self.data.max() < 128
            self._points = None if ascii_ else np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
            self._ascii = ascii_
        at = self.edges[text]
        return (places - at if self._ascii else self._points[places] - self._points[at]).astype(np.int32)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, number in it, start, end) of every line."""
        breaks = np.flatnonzero(self.data == 10)
        n = len(self.edges) - 1
        text = np.concatenate([np.arange(n), np.searchsorted(self.edges, breaks, "right") - 1])
        starts, order = np.concatenate([self.edges[:-1], breaks + 1]), np.argsort(text, kind="stable")
        own, ends = text[order], np.concatenate([breaks, self.edges[1:]])
        ends = ends[np.argsort(np.concatenate([text[n:], np.arange(n)]), kind="stable")]
        return own, np.arange(len(own)) - np.searchsorted(own, own), starts[order], ends

    def paragraphs(self, least: int) -> dict[str, np.ndarray]:
        """Lines of least words or more, and stretches of shorter lines without a blank one between that have as many together.

        text, unit (number among its text's paragraphs), para (number of its first line), start and end (bytes), first and last (words).
        """
        text, number, start, end = self.lines()
        first, last = np.searchsorted(self.starts, start), np.searchsorted(self.starts, end)
        n = last - first
        short = (n > 0) & (n < least)
        begins = np.ones(len(n), bool)
        begins[1:] = ~short[1:] | ~short[:-1] | (text[1:] != text[:-1])
        heads = np.flatnonzero(begins)
        tails = np.append(heads[1:], len(n)) - 1
        keep = last[tails] - first[heads] >= least
        heads, tails = heads[keep], tails[keep]
        own = text[heads]
        return {"text": own, "unit": np.arange(len(own)) - np.searchsorted(own, own), "para": number[heads], "start": start[heads], "end": end[tails], "first": first[heads], "last": last[tails]}

    def probes(self, least: int, probe: int, shingles: np.ndarray) -> np.ndarray:
        """Where probes of so many words start. Any least words in a row that occur twice hold a probe that starts at the same word in both.

        Of every least - probe + 1 places in a row the (first) one with the smallest shingle hash is chosen, whatever stands around them.
        """
        width, total = least - probe + 1, len(self.codes)
        if total < least:
            return np.empty(0, np.int64)
        value, place, span = shingles, np.arange(len(shingles), dtype=np.int64), 1
        while span < width:
            step = min(span, width - span)
            left, right = value[:-step], value[step:]
            less = right < left
            value, place = np.where(less, right, left), np.where(less, place[step:], place[:-step])
            span += step
        end = np.repeat(self.bounds[1:], np.diff(self.bounds))[: len(place)]
        chosen = place[np.arange(len(place)) + least <= end]
        return chosen[np.diff(chosen, prepend=-1) != 0]


by_value(__name__)
