"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged

__all__ = ["documents", "KeyFilter", "hold", "lean", "slices", "staged", "runs", "unused", "with_columns"]
SLICE = 1 << 16  # rows of a batch of narrow rows that a task gives out
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Called by a task that begins to use tables kept in its Python worker.

    Workers serve one operator after another. The tables of all others are
    dropped (``drop`` empties them), so a worker's memory is that of one
    operator; tasks of the same operator find their tables again.
    """
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = drop
    if others:
        release()


def release() -> None:
    """Give memory that this worker has freed back to the system; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: freed memory is reused all the same
        pass


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on batches, after which its worker keeps no memory that is free: workers wait beside each other and the JVM."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def slices(names: list[str], *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns of equal length as batches of at most ``SLICE`` rows, so that both sides hold little at once."""
    for lo in range(0, len(cols[0]), SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + SLICE]) for c in cols], names)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def with_columns(df: DataFrame, ddl: str) -> str:
    """Schema of ``df`` without the columns named in ``ddl``, followed by those of ``ddl``."""
    new = [x.strip() for x in ddl.split(",")]
    names = {x.split()[0] for x in new}
    old = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in names]
    return ", ".join(old + new)


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Whole groups of equal key from batches sorted by it, one table for each."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held)


FILTER_BITS = 1 << 24


class KeyFilter:
    """A bit for each of a table's keys (well mixed 64-bit numbers), in at most ``FILTER_BITS`` (2 MB).

    Tells which rows may have one of the keys without moving any. With more
    keys than that serves, it lets all rows pass.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.bits = 1 << max(10, (16 * keys.count()).bit_length())
        if self.bits > FILTER_BITS:
            self.bits, self.table = 0, np.zeros(0, np.uint64)
            return
        bits = self.bits
        slot = f"(`{column}` & {bits - 1}L)"
        words = keys.select(F.expr(f"shiftright({slot}, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("b"))
        self.table = np.zeros(bits // 64, np.uint64)
        for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
            self.table[r.w] = np.int64(r.b).view(np.uint64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.ones(len(keys), bool)
        at = keys.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

