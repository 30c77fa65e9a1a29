"""Global order without a global sort.

A window with no partition key, or with a hot one, runs in one task. The
functions here cut the order into buckets by an expression that never
decreases along it, total each bucket (a small frame), and add those totals to
running sums taken inside the buckets. Buckets of values come from a mergeable
quantile sketch of the values themselves, so they stay even however the values
crowd; ranks are exact because the counts inside buckets are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keys import col, radix_bucket

SALTS = 64
PARTS = 64  # quantile bounds of a key's values
RADIX_SPAN = 1 << 20  # more than twice the largest radix bucket


def attach(df: DataFrame, few: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a frame that has one row per ``on`` key (or one row in all).

    A plain join would send each key's rows, maybe a third of the table, to one
    task. The small side is repeated per salt so they spread; when it is small
    enough Spark broadcasts it and no row moves.
    """
    # as many as there are tasks, so that the spread grows with the cluster
    salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.join(few, [*on, "__salt"], how).drop("__salt")


def even_buckets(df: DataFrame, keys: Sequence[str], value: str, name: str, spread: Sequence[str]) -> DataFrame:
    """Adds ``name``, a bigint that never decreases with ``value`` and holds about 1 / PARTS of a key's rows.

    The sketch's bounds come first, the radix bucket splits what lies between
    two of them. NaN sorts above all, as in Spark.
    """
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    cuts = F.percentile_approx(known, [i / PARTS for i in range(1, PARTS)], 20 * PARTS)
    bounds = df.groupBy(*keys).agg(F.array_distinct(F.coalesce(cuts, F.array().cast("array<double>"))).alias("__cuts"))
    out = attach(df, bounds, keys, spread)
    above = F.size(F.filter("__cuts", lambda c: c < v)).cast("bigint")
    return out.withColumn(name, above * RADIX_SPAN + radix_bucket(v)).drop("__cuts")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str | Column,
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` within ``keys``.

    ``bucket`` must not decrease along the ascending ``order``. ``order`` should
    be unique per key, as after grouping by it.
    """
    df = df.withColumn("__bucket", col(bucket))
    for name, expr in sums.items():
        df = df.withColumn(f"__in_{name}", col(expr))
    way = F.desc if descending else F.asc
    per = df.groupBy(*keys, "__bucket").agg(*[F.sum(f"__in_{n}").alias(f"__t_{n}") for n in sums])
    before = W.partitionBy(*keys, F.lit(0)).orderBy(way("__bucket")).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        *keys,
        "__bucket",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in sums],
    )
    inside = (
        W.partitionBy(*keys, "__bucket").orderBy(*[way(o) for o in order]).rowsBetween(W.unboundedPreceding, 0)
    )
    out = df.join(per, [*keys, "__bucket"])
    out = out.withColumns({n: F.col(f"__base_{n}") + F.sum(f"__in_{n}").over(inside) for n in sums})
    return out.drop("__bucket", *[f"__in_{n}" for n in sums], *[f"__base_{n}" for n in sums])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, exact, one row per key.

    ``percentile`` holds a key's distinct values in one task. Here a histogram
    (combined map-side) finds the buckets that hold the wanted ranks, and only
    the values of those buckets are ranked.
    """
    w = F.col(weight) if weight else F.lit(1)
    df = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__v"), w.cast("bigint").alias("__w")
    )
    df = even_buckets(df, keys, "__v", "__b", ["__v", "__w"])
    hist = df.groupBy(*keys, "__b").agg(F.sum("__w").alias("__n"))
    part = W.partitionBy(*keys, F.lit(0))
    upto = part.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumns({"__cum": F.sum("__n").over(upto), "__total": F.sum("__n").over(part)})
    hist = hist.withColumn("__base", F.col("__cum") - F.col("__n"))
    hits = F.lit(False)
    for q in fractions.values():
        pos = (F.col("__total") - 1) * F.lit(float(q))
        # zero-based ranks floor(pos) and floor(pos)+1 fall in these buckets
        hits = hits | ((F.floor(pos) + 1 >= F.col("__base")) & (F.floor(pos) < F.col("__cum")))
    wanted = hist.filter(hits).select(*keys, "__b", "__base", "__total")
    # the rows of other buckets go before anything is grouped
    vals = df.join(wanted, [*keys, "__b"]).groupBy(*keys, "__b", "__v").agg(
        F.sum("__w").alias("__n"), F.first("__base").alias("__base"), F.first("__total").alias("__total")
    )
    inside = W.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    vals = vals.withColumn("__cum", F.col("__base") + F.sum("__n").over(inside))
    aggs = []
    for name, q in fractions.items():
        pos = (F.col("__total") - 1) * F.lit(float(q))
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("__total") - 1)
        start = F.col("__cum") - F.col("__n")
        aggs += [
            F.max(F.when((lo >= start) & (lo < F.col("__cum")), F.col("__v"))).alias(f"__lo_{name}"),
            F.max(F.when((hi >= start) & (hi < F.col("__cum")), F.col("__v"))).alias(f"__hi_{name}"),
            F.max(pos - lo).alias(f"__f_{name}"),
        ]
    out = vals.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n)
            for n in fractions
        ],
    )


def smallest_keys(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str | Column,
    order: Sequence[str],
    limit: str | Column,
) -> DataFrame:
    """The rows ranked 1..``limit`` by ``order`` within ``keys``; adds ``rank``.

    Whole buckets below the cut pass by their totals; rows in buckets past it
    are dropped before anything is ranked.
    """
    df = df.withColumns({"__bucket": col(bucket), "__limit": col(limit)})
    per = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys, F.lit(0)).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    out = df.join(per, [*keys, "__bucket"]).filter(F.col("__base") < F.col("__limit"))
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order)
    out = out.withColumn("rank", F.col("__base") + F.row_number().over(inside))
    return out.filter(F.col("rank") <= F.col("__limit")).drop("__bucket", "__limit", "__base")
