"""Arrow batches cut to a bounded number of text bytes, and word arithmetic on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step of a kernel holds at a time (one longer text stands alone).
STEP_BYTES = 2 << 20
#: Bytes of words that are hashed at a time, and of a longer word's pieces.
RUN_BYTES, PIECE = 1 << 20, 1 << 16
#: Modulus and base of the word hash that SQL can recompute.
HASH_MOD, HASH_BASE = 2_147_483_647, 1_000_003


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` has at most about `limit` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(total[stop - 1])


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values end to end, and the n + 1 offsets; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    values = array.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blobs(array: pa.Array) -> list[bytes]:
    """Each value's UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def powers(base: int, n: int, mod: int | None = None) -> np.ndarray:
    """base**0 .. base**(n-1), modulo `mod` or 2**64."""
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    while len(out) < n:
        more = out * step
        out = np.concatenate([out, more % np.uint64(mod) if mod else more])
        step = np.uint64(int(step) ** 2 % (mod or 1 << 64))
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: `bounds` has the n + 1 places at which each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~SPACE[data]
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = inside
        after = before[1:].copy()
        after[:-1] = inside[1:]
        after[-1:] = False
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.data, self.inside = data, inside

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: the Horner hash modulo HASH_MOD over its UTF-8 bytes, and another of 64 bits. Words are taken in
        runs of about RUN_BYTES, and a word of more than PIECE bytes in pieces, so that memory doesn't follow a text."""
        lengths = self.ends - self.starts
        small, large = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint64)
        step = np.uint64(pow(HASH_BASE, PIECE, HASH_MOD)), np.uint64(pow(0x9E3779B97F4A7C15, PIECE, 1 << 64))
        long = lengths > PIECE
        for i in np.flatnonzero(long).tolist():
            for begin in range(int(self.starts[i]), int(self.ends[i]), PIECE):
                end = min(begin + PIECE, int(self.ends[i]))
                a, b = self._folded(np.array([begin]), np.array([end]))
                last = end - begin < PIECE
                up = (np.uint64(pow(HASH_BASE, end - begin, HASH_MOD)), np.uint64(pow(0x9E3779B97F4A7C15, end - begin, 1 << 64))) if last else step
                small[i] = (small[i] * up[0] + a[0]) % np.uint64(HASH_MOD)
                large[i : i + 1] = large[i : i + 1] * up[1] + b
        short = np.flatnonzero(~long)
        total = np.cumsum(lengths[short])
        begin = 0
        while begin < len(short):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + RUN_BYTES, "right")))
            own = short[begin:end]
            small[own], large[own] = self._folded(self.starts[own], self.ends[own])
            begin = end
        return small, mix(large + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _folded(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(at, lengths)
        byte = self.data[np.repeat(starts, lengths) + place].astype(np.uint64)
        far = np.repeat(lengths, lengths) - 1 - place
        longest = int(lengths.max())
        small = np.add.reduceat(powers(HASH_BASE, longest, HASH_MOD)[far] * byte, at) % np.uint64(HASH_MOD)
        return small, np.add.reduceat(powers(0x9E3779B97F4A7C15, longest)[far] * (byte + np.uint64(0x51)), at)


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    cum = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return cum[bounds[1:]] - cum[bounds[:-1]]
