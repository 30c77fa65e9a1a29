"""Column expressions for ordering, bucketing and deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DAY


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(ms: str | Column, width: int) -> Column:
    """Start of the ``width``-wide interval holding ``ms`` (also below zero)."""
    return col(ms) - F.pmod(col(ms), F.lit(width))


def day_of(ms: str | Column) -> Column:
    """Days since the epoch, UTC, free of the session time zone."""
    return ((col(ms) - F.pmod(col(ms), F.lit(DAY))) / DAY).cast("int")


def draw_key(seed: int | Column, *parts: str | Column) -> Column:
    """32 hex digits, uniform and the same in every engine."""
    cols = [seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))] + [col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def draw_int(seed: int | Column, *parts: str | Column) -> Column:
    """First 32 bits of :func:`draw_key` as a bigint."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def key_bucket(key: str | Column) -> Column:
    """4096 ordered buckets of a hex key."""
    return F.substring(col(key), 1, 3)


def radix_bucket(x: str | Column, per_octave: int = 64) -> Column:
    """Bigint bucket that never decreases with ``x``: log scale on both sides of 0.

    Only monotonicity matters for the results that use it. The log scale keeps
    buckets small for scores of any magnitude without a first pass over them.
    Infinities fall in the end buckets, NaN above all, as Spark sorts it.
    """
    v = col(x).cast("double")
    most = F.lit(2_200 * per_octave).cast("bigint")
    finite = F.when(F.abs(v) < float("inf"), v)
    mag = F.floor(F.log2(F.abs(finite)) * per_octave).cast("bigint") + F.lit(1_100 * per_octave)
    mag = F.coalesce(mag + 1, most)
    return F.when(F.isnan(v), most + 1).when(v == 0, F.lit(0).cast("bigint")).when(v > 0, mag).otherwise(-mag)


def tape_order(time: str | Column, agg_id: str | Column, origin: Column, span_ms: int, wide: bool = False) -> Column:
    """One primitive value that sorts like (time, agg_id) within ``span_ms``.

    Aggregates ordered by a struct fall back to sort-based aggregation; a long
    keeps them in the hash aggregate. Ids beyond the free bits stop the job
    rather than sort wrongly; ``wide=True`` takes any id with a decimal key.
    """
    if wide:
        return col(time).cast("decimal(19,0)") * F.expr("20000000000000000000BD") + col(agg_id)
    bits = 63 - int(span_ms).bit_length()
    limit = F.lit(1 << bits)
    packed = (col(time) - origin) * limit + col(agg_id)
    return F.when(
        (col(agg_id) < 0) | (col(agg_id) >= limit),
        F.raise_error(F.lit(f"agg_id needs more than {bits} bits: use wide ordering")).cast("bigint"),
    ).otherwise(packed)


def finite_or_zero(x: str | Column) -> Column:
    v = col(x).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def positive_log(x: str | Column) -> Column:
    """ln(x), null where it is not finite."""
    return F.when(col(x) > 0, F.log(col(x)))


def ratio(num: Column, den: Column) -> Column:
    """num/den, null where den is 0."""
    return F.when(den != 0, num / den)


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))
