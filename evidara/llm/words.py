"""Words of Arrow text columns as numpy arrays: positions, 64-bit hashes, rolling window hashes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; as these separators are ASCII,
working on UTF-8 bytes gives the same words as working on characters."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Odd multipliers of the polynomial hashes, and their inverses modulo 2**64.
BYTE_BASE, WINDOW_BASES = 0x9E3779B97F4A7C15, (0xD1342543DE82EF95, 0xDA942042E4DD58B5)
CHUNK_BYTES = 1 << 20
_LIBC = ctypes.CDLL(None)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of one base, kept between batches."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    #: Powers kept between batches, 16 bytes each; a longer text's are worked out anew.
    KEPT = 1 << 21

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return _powers(self.base, n), _powers(self.inverse, n)
        if len(self.up) < n:
            kept = min(self.KEPT, n + n // 8)
            self.up, self.down = _powers(self.base, kept), _powers(self.inverse, kept)
        return self.up[:n], self.down[:n]


_BYTES, _WINDOWS = _Powers(BYTE_BASE), [_Powers(b) for b in WINDOW_BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are document d's words; ``start``/``end`` index into ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, by differences of prefix sums."""
        up, down = _BYTES.get(len(self.data))
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``k`` consecutive entries of ``h``."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WINDOWS[which].get(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` entries, by doubling."""
    if len(x) < w:
        return x[:0]
    span, m = 1, x
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def bucketed(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, rest): an order by bucket, the lowest ``bits`` (8 or more) of each hash in it, and seven bytes that with the bucket are the whole hash."""
    key = (h & np.uint64((1 << bits) - 1)) << np.uint64(64 - bits) | h >> np.uint64(bits)
    order = np.argsort(key)
    key = key[order]
    rest = (key & np.uint64((1 << (64 - bits)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return order, (key >> np.uint64(64 - bits)).astype(np.int64), np.ascontiguousarray(rest)


def from_seven(raw: np.ndarray) -> np.ndarray:
    """Seven bytes each as numbers."""
    eight = np.zeros((len(raw) // 7, 8), dtype=np.uint8)
    eight[:, :7] = raw.reshape(-1, 7)
    return eight.view("<u8").ravel()


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(lo, hi) for lo, hi in zip(cut[:-1], cut[1:], strict=True) if hi > lo]


def layout(texts: pa.Array, lower: bool = False) -> Words:
    """The words of an Arrow string array; null texts have none."""
    a = texts.cast(pa.large_string()).fill_null("")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task does not hold it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def chunks(batches, column: str):
    """Cut record batches so that the texts of each piece stay under CHUNK_BYTES (or are one row)."""
    try:
        yield from _chunks(batches, column)
    finally:
        give_back()


def _chunks(batches, column: str):
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(sizes) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(lo, hi - lo)


def squeeze(docs):
    """``docs`` with its column ``text`` as Zstandard bytes ``z``, for shuffles of whole texts."""
    import zstandard

    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "z binary"])

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [z.compress(t.as_buffer()) if t.is_valid else None for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.binary())], names=[*names, "z"])
        give_back()

    return docs.mapInArrow(run, schema)


def unsqueezed(batches):
    """Record batches with column ``z`` back as ``text``, a few documents at a time."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        for lo in range(0, b.num_rows, 128):
            part = b.slice(lo, 128)
            texts = [None if t is None else z.decompress(t).decode("utf-8") for t in part.column("z").to_pylist()]
            names = [n for n in part.schema.names if n != "z"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.large_string())], names=[*names, "text"])
