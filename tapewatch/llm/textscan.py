"""Whole-batch text scans: words, lines and their hashes, in numpy inside Arrow batches.

A batch of texts is one UTF-8 byte array. White space and the letters A-Z are
single bytes that occur in no other code point, so words and lines can be cut
and lower-cased on bytes. The hash of a span is a difference of running sums
of a polynomial over random byte values, so it costs a few array passes for
all spans of a batch, whatever their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BATCH_BYTES = 1 << 20  # texts worked on at once; bounds what a task holds
POWERS = BATCH_BYTES + (1 << 17)  # powers kept, 9 MB for each of four tables; longer batches make their own
_RNG = np.random.default_rng(20240607)
_BYTE_VALUES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.int64).view(U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between batches."""
    key = (seed, inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = _BASE[seed] if not inverse else pow(_BASE[seed], -1, 1 << 64)
        size = max(n, POWERS)
        p = np.full(size, U64(base))
        p[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(p)
        if size <= POWERS:
            _powers[key] = have
    return have[:n]


class Scan:
    """Bytes of several texts, each ended by one separator byte ``\\n``.

    ``ends[i]`` is the place of the separator behind text i.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens
        self.low = _LOWER[self.data] if lower else self.data
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the (lower-cased) bytes of each span; depends on content alone."""
        n = len(self.data) + 1
        if seed not in self._sums:
            with np.errstate(over="ignore"):
                s = np.zeros(n, U64)
                np.cumsum(_BYTE_VALUES[seed][self.low] * powers(n - 1, seed), out=s[1:])
            self._sums[seed] = s
        s = self._sums[seed]
        with np.errstate(over="ignore"):
            return mix((s[end] - s[start]) * powers(n, seed, True)[start] + (end - start).astype(U64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each run of other bytes than white space, and its text's number."""
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, z
        # with a separator in front and behind, every run has two borders
        space = _SPACE[self.data]
        borders = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1]]))
        start, end = borders[0::2], borders[1::2]
        return start, end, np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(start, self.ends), prepend=0))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each line (separator excluded) and its text's number."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return start, end, np.searchsorted(self.ends, end)

    def stripped(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without the white space at both ends."""
        solid = np.flatnonzero(~_SPACE[self.data])
        if not len(solid):
            return start, start
        a = np.searchsorted(solid, start)
        b = np.searchsorted(solid, end)
        some = b > a
        first = np.where(some, solid[np.minimum(a, len(solid) - 1)], start)
        last = np.where(some, solid[np.maximum(b, 1) - 1] + 1, start)
        return first, last

    def code_points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        heads = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return heads[end] - heads[start]


def shingle_sets(scan: Scan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: (text number, hash), sorted by both.

    A text with fewer than k words has its whole sequence as its one shingle.
    """
    start, end, doc = scan.words()
    h = scan.hashes(start, end)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    count = np.bincount(doc, minlength=len(scan.ends))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    with np.errstate(over="ignore"):
        m = max(n - k + 1, 0)
        acc = np.zeros(m, U64)
        for j in range(k):
            acc = (acc + h[j : j + m]) * U64(0xD6E8FEB86659FD93)
    whole = doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)
    docs, sh = [doc[:m][whole]], [mix(acc[whole])]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = np.zeros(len(few), U64)
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                has = count[few] > j
                short[has] = (short[has] + h[first[few[has]] + j]) * U64(0xA0761D6478BD642F)
            short += count[few].astype(U64)
        docs.append(few)
        sh.append(mix(short))
    d, s = np.concatenate(docs), np.concatenate(sh)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[keep], s[keep]


def text_batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of record batches with their texts as bytes (null: empty).

    A piece ends at about ``BATCH_BYTES``, so that memory does not follow the
    number of rows in a batch; one text is never cut.
    """
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(text).cast(pa.large_binary())
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(size + 1) // BATCH_BYTES
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield b.slice(lo, hi - lo), [x or b"" for x in col.slice(lo, hi - lo).to_pylist()]


def ids_of(b: pa.RecordBatch, col: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A bigint column as values (null: 0) and a mask of nulls."""
    c = b.column(col)
    null = c.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64), null
