"""Elias-Fano sequences over memory-mapped files, and a container for them.

A sequence of n sorted numbers below u keeps floor(log2(u / n)) low bits of each in
a packed array and the rest in unary: number i sets bit (value >> low) + i. Every
BLOCK numbers the position in the unary bits and the first value are stored.

Queries come sorted and in batches. Where they are dense, the blocks that they fall
into are decoded at a stroke; where they are sparse, each is answered from the bits
themselves: the zeros before its high part are counted off, and the low parts behind
them are searched. So a query's cost doesn't grow with the sequence.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid

import numpy as np

BLOCK = 64
#: Low bits of a number at most, so that one read of eight bytes has them all.
MAX_LOW = 56
#: Blocks that are decoded at a time.
CHUNK = 1 << 12
#: Numbers to decode for a query from which on it is answered from the bits.
SPARSE = 10
WINDOW = 56  # bits that one read of eight bytes has from any bit on
_ONES = np.uint64((1 << WINDOW) - 1)
#: The place of the r-th one in seven bits.
_SELECT = np.array([[([i for i in range(7) if v >> i & 1] + [7] * 7)[r] for r in range(7)] for v in range(128)], dtype=np.int64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of a sorted sequence of numbers below universe."""
    values = values.astype(np.uint64)
    n = len(values)
    low = min(MAX_LOW, max(0, (universe // max(n, 1)).bit_length() - 1))
    at = np.arange(n, dtype=np.uint64)
    place = (values >> np.uint64(low)) + at
    total = int(place[-1]) + 1 if n else 0
    bits = np.zeros(total + 2 * 64, dtype=np.uint8)  # room to read beyond the end
    bits[place.astype(np.int64)] = 1
    packed = [np.zeros(0, dtype=np.uint8)]
    for i in range(0, n, 1 << 16):  # a multiple of eight numbers, so of whole bytes
        part = values[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (low + 7) // 8]
        packed.append(np.packbits(np.unpackbits(part, axis=1, count=low, bitorder="little").ravel(), bitorder="little"))
    return {
        "shape": np.array([n, low], dtype=np.uint64),
        "high": np.packbits(bits, bitorder="little"),
        "low": np.concatenate([*packed, np.zeros(16, dtype=np.uint8)]),  # room to read beyond the end
        "starts": np.concatenate([place[::BLOCK], [total]]).astype(np.uint64),
        "firsts": values[::BLOCK].copy(),
    }


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every byte, as numbers."""
    return np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))


class Sequence:
    """A sequence read from arrays that encode() made."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low = (int(x) for x in arrays["shape"])
        self.high, self.bits, self.starts, self.firsts = arrays["high"], arrays["low"], arrays["starts"], arrays["firsts"]

    def __len__(self) -> int:
        return self.n

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(index), dtype=np.uint64)
        bit = index * self.low
        found = _words(self.bits)[bit >> 3] >> (bit & 7).astype(np.uint64)
        return found & np.uint64((1 << self.low) - 1)

    def _decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the numbers in these blocks (increasing)."""
        if len(blocks) == blocks[-1] - blocks[0] + 1:
            return self._decode_run(int(blocks[0]), int(blocks[-1]))
        starts, ends = self.starts[blocks].astype(np.int64), self.starts[blocks + 1].astype(np.int64)
        first, length = starts >> 3, ((ends + 7) >> 3) - (starts >> 3)
        shift = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        where = shift + np.arange(len(shift))
        ones = np.flatnonzero(np.unpackbits(self.high[where], bitorder="little"))
        place = (where[ones >> 3] << 3) + (ones & 7)
        owner = np.repeat(np.arange(len(blocks)), length)[ones >> 3]
        place = place[(place >= starts[owner]) & (place < ends[owner])]
        count = np.minimum(BLOCK, self.n - blocks * BLOCK)
        index = np.repeat(blocks * BLOCK - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return index, ((place - index).astype(np.uint64) << np.uint64(self.low)) | self._lows(index)

    def _decode_run(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the blocks from first to last."""
        start, end = int(self.starts[first]), int(self.starts[last + 1])
        ones = np.flatnonzero(np.unpackbits(self.high[start >> 3 : (end + 7) >> 3], bitorder="little"))
        ones += start >> 3 << 3
        lead = int(np.searchsorted(ones, start))
        index = np.arange(first * BLOCK, min((last + 1) * BLOCK, self.n))
        place = ones[lead : lead + len(index)]
        return index, ((place - index).astype(np.uint64) << np.uint64(self.low)) | self._lows(index)

    def _each(self, blocks: np.ndarray):
        """Slices of queries with the decoded blocks they need; blocks: per query, sorted."""
        if not len(blocks):
            return
        new = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        needed = blocks[new]
        for i in range(0, len(needed), CHUNK):
            begin = new[i]
            end = new[i + CHUNK] if i + CHUNK < len(needed) else len(blocks)
            part = needed[i : i + CHUNK]
            if part[-1] - part[0] < 3 * len(part):  # dense: decode the gaps as well
                part = np.arange(part[0], part[-1] + 1)
            yield slice(begin, end), *self._decode(part)

    def _nth(self, at: np.ndarray, nth: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the nth (from 1) one or zero of the unary bits from `at` on."""
        words, at, nth = _words(self.high), at.copy(), nth.copy()
        window = np.empty(len(at), dtype=np.uint64)
        open_ = np.arange(len(at))
        last = (len(self.high) - 8) * 8
        while len(open_):
            p = np.minimum(at[open_], last)
            w = (words[p >> 3] >> (p & 7).astype(np.uint64)) & _ONES
            if not ones:
                w ^= _ONES
            window[open_] = w
            count = np.bitwise_count(w).astype(np.int64)
            open_ = open_[(more := (nth[open_] > count) & (p < last))]
            at[open_] += WINDOW
            nth[open_] -= count[more]
        shift = np.zeros(len(at), dtype=np.int64)
        for width in (28, 14, 7):
            low = window & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            beyond = nth > count
            nth -= np.where(beyond, count, 0)
            window = np.where(beyond, window >> np.uint64(width), low)
            shift += np.where(beyond, width, 0)
        return at + shift + _SELECT[(window & np.uint64(127)).astype(np.int64), np.clip(nth - 1, 0, 6)]

    def _run_of_ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones of the unary bits from `at` on, before the next zero."""
        p = np.minimum(at, (len(self.high) - 8) * 8)
        w = (_words(self.high)[p >> 3] >> (p & 7).astype(np.uint64)) & _ONES
        run = np.bitwise_count(w & ~(w + np.uint64(1))).astype(np.int64)
        long = np.flatnonzero((run == WINDOW) | (p < at))
        if len(long):
            run[long] = self._nth(at[long], np.ones(len(long), dtype=np.int64), False) - at[long]
        return run

    def _is_sparse(self, blocks: np.ndarray) -> bool:
        """blocks: of each query, sorted."""
        if not len(blocks):
            return False
        touched = 1 + int(np.count_nonzero(blocks[1:] != blocks[:-1]))
        span = int(blocks[-1] - blocks[0]) + 1
        return (span if span < 3 * touched else touched) * BLOCK > SPARSE * len(blocks)

    def _find_each(self, queries: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """find() of queries one by one; blocks: the block of each."""
        start = self.starts[blocks].astype(np.int64)
        zeros = (queries >> np.uint64(self.low)).astype(np.int64) - (start - blocks * BLOCK)  # in the block, before the high part
        at = start.copy()
        later = np.flatnonzero(zeros > 0)
        at[later] = self._nth(start[later], zeros[later], False) + 1
        low = blocks * BLOCK + (at - start) - zeros
        limit = np.minimum((blocks + 1) * BLOCK, self.n)
        high = end = np.minimum(low + self._run_of_ones(at), limit)
        wanted = queries & np.uint64((1 << self.low) - 1)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            less = self._lows(middle) < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high = high.copy()
            high[open_[~less]] = middle[~less]
        found = np.full(len(queries), -1, dtype=np.int64)
        inside = np.flatnonzero(low < end)
        inside = inside[self._lows(low[inside]) == wanted[inside]]
        found[inside] = low[inside]
        return found

    def last_not_above(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted queries the index and the value of the last number that is not
        above it; index -1 where all are."""
        index, value = np.full(len(queries), -1, dtype=np.int64), np.zeros(len(queries), dtype=np.uint64)
        if not self.n:
            return index, value
        blocks = np.searchsorted(self.firsts, queries, "right").astype(np.int64) - 1
        lead = int(np.searchsorted(blocks, 0))
        for part, ids, values in self._each(blocks[lead:]):
            own = slice(lead + part.start, lead + part.stop)
            at = np.searchsorted(values, queries[own], "right") - 1
            index[own], value[own] = ids[at], values[at]
        return index, value

    def find(self, queries: np.ndarray) -> np.ndarray:
        """The index of each of the sorted queries, -1 where it is no member."""
        if self.n:
            blocks = np.searchsorted(self.firsts, queries, "right").astype(np.int64) - 1
            if self._is_sparse(blocks):
                lead = int(np.searchsorted(blocks, 0))
                return np.concatenate([np.full(lead, -1, dtype=np.int64), self._find_each(queries[lead:], blocks[lead:])])
        index, value = self.last_not_above(queries)
        return np.where((index >= 0) & (value == queries), index, -1)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at sorted indices."""
        out = np.zeros(len(index), dtype=np.uint64)
        if self._is_sparse(index // BLOCK):
            place = self._nth(self.starts[index // BLOCK].astype(np.int64), index % BLOCK + 1, True)
            return ((place - index).astype(np.uint64) << np.uint64(self.low)) | self._lows(index)
        for part, ids, values in self._each(index // BLOCK):
            out[part] = values[np.searchsorted(ids, index[part])]
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays. It appears under its name only when complete, so a
    task that runs twice does no harm."""
    table, at = {}, 0
    for name, a in arrays.items():
        at = -(-at // 64) * 64
        table[name] = [a.dtype.str, at, len(a)]
        at += a.nbytes
    head = json.dumps(table).encode()
    base = -(-(8 + len(head)) // 64) * 64
    store, path = _filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(np.uint64(len(head)).tobytes() + head)
        written = 8 + len(head)
        for name, a in arrays.items():
            out.write(b"\0" * (base + table[name][1] - written) + np.ascontiguousarray(a).tobytes())
            written = base + table[name][1] + a.nbytes
    store.move(own, path)


class Mapped(dict):
    """Named arrays of a memory-mapped file."""

    def __init__(self, memory: mmap.mmap):
        super().__init__()
        self.memory = memory

    def release(self) -> None:
        """Take the pages read so far out of this process; the next read maps them again."""
        self.memory.madvise(mmap.MADV_DONTNEED)


def open_mapped(uri: str) -> Mapped:
    """The arrays of a file, memory-mapped. A file in a store that can't be mapped is
    copied to an unnamed temporary file first, which goes when it is unmapped."""
    from pyarrow import fs

    store, path = _filesystem(uri)
    if isinstance(store, fs.LocalFileSystem):
        file = open(path, "rb")
    else:
        file = tempfile.TemporaryFile()
        with store.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                file.write(block)
        file.flush()
    with file:
        out = Mapped(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    data = np.frombuffer(out.memory, dtype=np.uint8)
    size = int(data[:8].view("<u8")[0])
    base = -(-(8 + size) // 64) * 64
    for name, (kind, at, n) in json.loads(data[8 : 8 + size].tobytes()).items():
        out[name] = data[base + at : base + at + n * np.dtype(kind).itemsize].view(kind)
    return out


def named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def sequence(arrays: dict[str, np.ndarray], prefix: str) -> Sequence:
    return Sequence({k: arrays[f"{prefix}.{k}"] for k in ("shape", "high", "low", "starts", "firsts")})
