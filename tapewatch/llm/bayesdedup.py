"""Near duplicates by MinHash bands, sequential Bayesian pruning and exact verification.

Equal shingle sets are one class. Each class has a signature of
``bands * rows`` minima. Classes that agree in a whole band are candidates.
Before any set is moved, a candidate pair's signatures are compared a batch at
a time: with a uniform prior of the similarity s, the posterior after m of n
equal places is Beta(m + 1, n - m + 1), so

    P(s >= t | m, n) = P(Bin(n + 1, t) <= m),

and the pair is dropped as soon as that is below ``miss``. What is left after
the last batch is verified on the full sets; nothing is linked without it.

Misses: at similarity 0.8 bands of 5 out of 200 minima miss a pair with
probability 1.3e-7, and pruning at 1e-7 adds less than one in a million.

Pairs inside a band's bucket are not made one by one. The smallest class of a
bucket is its centre; all others are compared with it. Only members that are
not linked to it are compared with the whole group, in blocks of at most
``BLOCK`` by ``BLOCK`` classes a task. A block returns only links that join
classes not joined before, so a group of many similar texts does not return
all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .tables import KeyFilter, runs, staged
from .textscan import U64, Scan, ids_of, mix, shingle_sets, text_batches

BANDS, ROWS = 40, 5
BATCHES = (25, 50, 100, 200)  # places of a signature compared by then
MISS = 1e-7
BLOCK = 256  # classes of one side of a block


def factors(n: int) -> np.ndarray:
    """Odd multipliers of the n hash functions."""
    return mix(np.arange(1, n + 1, dtype=U64) ^ U64(0x5DEECE66D)) | U64(1)


def signatures(at: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """n minima of each set; set i begins at ``at[i]`` in ``grams`` and is not empty."""
    out = np.empty((len(at), n), np.uint32)
    with np.errstate(over="ignore"):
        for j, a in enumerate(factors(n)):
            out[:, j] = np.minimum.reduceat(grams * a, at) >> U64(32)
    return out


def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest of n equal places with which the posterior P(similarity >= percent / 100) is at least ``miss``."""
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def digests(n: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed shingles for each set of sizes n; equal sets have equal sums."""
    some, at = n > 0, np.cumsum(n) - n
    d1, d2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
    if len(grams):
        with np.errstate(over="ignore"):
            d1[some] = np.add.reduceat(mix(grams ^ U64(0x71C9)), at[some])
            d2[some] = np.add.reduceat(mix(grams ^ U64(0x3A5F17)), at[some])
    return d1, d2


def _fresh_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """(batch, sizes, d1, d2, rows whose set has an id and is the task's first of its kind, text number, shingle)."""
    seen: set[tuple[int, int]] = set()
    for b, texts in text_batches(batches):
        d, s = shingle_sets(Scan(texts), k)
        n = np.bincount(d, minlength=len(texts))
        d1, d2 = digests(n, s)
        null = ids_of(b)[1]
        fresh = np.zeros(len(n), bool)
        for i in np.flatnonzero((n > 0) & ~null):
            key = (int(d1[i]), int(d2[i]))
            if key not in seen:
                seen.add(key)
                fresh[i] = True
        yield b, n, d1, d2, fresh, d, s


def _sign(k: int, places: int):
    def run(batches):
        for b, n, d1, d2, fresh, d, s in _fresh_sets(batches, k):
            keep = fresh[d]
            size = n[fresh]
            sig = signatures(np.cumsum(size) - size, s[keep], places) if len(size) else np.zeros((0, places), np.uint32)
            raw = iter(sig)
            col = pa.array([next(raw).tobytes() if f else None for f in fresh], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), col], ["id", "n", "d1", "d2", "sig"]
            )

    return run


def _bands(bands: int, rows: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(0).to_numpy()
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(len(c), bands, rows)
            with np.errstate(over="ignore"):
                h = mix(np.broadcast_to(np.arange(bands, dtype=U64), (len(c), bands)))
                for j in range(rows):
                    h = mix(h ^ sig[:, :, j].astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(c, bands))], ["band", "c"])

    return run


def compatible(left: np.ndarray, right: np.ndarray, percent: int, miss: float, batches: tuple[int, ...] = BATCHES) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of ``left`` and ``right`` (signatures) whose pair no batch prunes."""
    same = np.zeros((len(left), len(right)), np.int16)
    for j in range(batches[0]):
        same += left[:, j, None] == right[None, :, j]
    x, y = np.nonzero(same >= least_matches(batches[0], percent, miss))
    m = same[x, y].astype(np.int64)
    for lo, hi in zip(batches[:-1], batches[1:], strict=True):
        m += (left[x, lo:hi] == right[y, lo:hi]).sum(1)
        keep = m >= least_matches(hi, percent, miss)
        x, y, m = x[keep], y[keep], m[keep]
    return x, y


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The two sides of each task, where both are there."""
    for t in runs(batches):
        side = t.column("side").to_numpy()
        if (side == 0).any() and (side == 1).any():
            yield t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))


def _classes(t: pa.Table) -> np.ndarray:
    return t.column("c").to_numpy()


def _rows(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in t.column(name).to_pylist()]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])


def _prune(percent: int, miss: float, steps: tuple[int, ...]):
    """Pairs (a, b) of a star that the signatures leave."""

    def run(batches):
        for l, r in _sides(batches):
            x, y = compatible(np.stack(_rows(l, "sig", np.uint32)), np.stack(_rows(r, "sig", np.uint32)), percent, miss, steps)
            yield _pairs(_classes(l)[x], _classes(r)[y])

    return run


def _survivors(percent: int, miss: float, steps: tuple[int, ...]):
    """The rows of a block that have a partner in it which the signatures leave; not the pairs, which may be many."""

    def run(batches):
        for l, r in _sides(batches):
            cl, cr = _classes(l), _classes(r)
            x, y = compatible(np.stack(_rows(l, "sig", np.uint32)), np.stack(_rows(r, "sig", np.uint32)), percent, miss, steps)
            other = cl[x] != cr[y]
            kl, kr = cl[np.unique(x[other])], cr[np.unique(y[other])]
            c = np.concatenate([kl, kr])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c), l.column("task")[0].as_py())), pa.array(np.repeat([0, 1], [len(kl), len(kr)]).astype(np.int32)), pa.array(c)],
                ["task", "side", "c"],
            )

    return run


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections of a sorted set with others, and their sizes."""
    cat, sizes = np.concatenate(others), np.array([len(v) for v in others])
    i = np.minimum(np.searchsorted(one, cat), len(one) - 1)
    return np.bincount(np.repeat(np.arange(len(others)), sizes), one[i] == cat, len(others)).astype(np.int64), sizes


def _confirm(percent: int):
    """Links of a star by the full sets."""

    def run(batches):
        for l, r in _sides(batches):
            one = _rows(l, "grams", U64)[0]
            both, sizes = overlaps(one, _rows(r, "grams", U64))
            linked = 100 * both >= percent * (len(one) + sizes - both)
            yield _pairs(np.full(int(linked.sum()), _classes(l)[0]), _classes(r)[linked])

    return run


def _forest(percent: int, miss: float, steps: tuple[int, ...]):
    """Verified links that join a block's classes as all its links do: a pair already joined needs no look."""

    def run(batches):
        for l, r in _sides(batches):
            cl, cr = _classes(l), _classes(r)
            left, right = _rows(l, "grams", U64), _rows(r, "grams", U64)
            x, y = compatible(np.stack(_rows(l, "sig", np.uint32)), np.stack(_rows(r, "sig", np.uint32)), percent, miss, steps)
            ids, at = np.unique(np.concatenate([cl, cr]), return_inverse=True)
            group = np.arange(len(ids))
            found: list[tuple[int, int]] = []
            for i in np.unique(x):
                u = at[i]
                ys = y[x == i]
                ys = ys[group[at[len(cl) + ys]] != group[u]]
                if not len(ys):
                    continue
                both, sizes = overlaps(left[i], [right[j] for j in ys])
                for j in ys[100 * both >= percent * (len(left[i]) + sizes - both)]:
                    v = at[len(cl) + j]
                    if group[v] != group[u]:
                        group[group == group[v]] = group[u]
                        found.append((cl[i], cr[j]))
            if found:
                yield _pairs(*np.array(found, np.int64).T)

    return run


def _sets(k: int, wanted: KeyFilter):
    """(d1, d2, shingles) of the rows whose digest may be wanted, each set once a task."""

    def run(batches):
        for _, n, d1, d2, fresh, d, s in _fresh_sets(batches, k):
            stop = np.cumsum(n)
            at = np.flatnonzero(fresh & wanted.may_hold(d1))
            raw = [s[stop[i] - n[i] : stop[i]].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(d1[at].view(np.int64)), pa.array(d2[at].view(np.int64)), pa.array(raw, pa.binary())], ["d1", "d2", "grams"])

    return run


def _chunks(n: str) -> F.Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _stars(pairs: DataFrame, centre: str, other: str) -> DataFrame:
    """Tasks (task, side, c) of one ``centre`` against at most about ``BLOCK`` of its partners each."""
    sizes = staged(pairs.groupBy(centre).agg(F.count("*").alias("g")), "sizes")
    dealt = pairs.join(sizes, centre).withColumn("task", F.xxhash64(centre, F.pmod(F.hash(other), _chunks("g"))))
    return dealt.select("task", F.lit(1).alias("side"), F.col(other).alias("c")).unionByName(
        dealt.select("task", F.lit(0).alias("side"), F.col(centre).alias("c")).distinct()
    )


def _work(tasks: DataFrame, held: list[DataFrame], fn, ddl: str = "a bigint, b bigint") -> DataFrame:
    """What ``fn`` returns for the tasks, with the classes' signatures or sets beside them."""
    for h in held:
        tasks = tasks.join(h, "c")
    tasks = tasks.select("task", *[c for c in tasks.columns if c != "task"])
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(fn, ddl)


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents linked where 100 * intersection >= ``percent`` * union of their k-word shingles.

    Returns a row for each row of ``docs``: ``id_col``; ``n_shingles``; the
    digests ``d1``, ``d2`` of the set (equal for equal sets); ``component_id``,
    the smallest id reachable by links, itself included; ``kept``, whether the
    row's id is its component.

    A null text or one without words has an empty set, is linked with nothing
    and is its own component. A text of fewer than k words has its whole
    sequence as one shingle. Rows that repeat an id are all returned; their
    sets have the id in common and so one component. A row with null id joins
    the component of an equal set and is not kept; without one its component
    is null and it is kept. Other columns play no part.
    """
    places = bands * rows
    steps = tuple(b for b in BATCHES if b < places) + (places,)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    seen = docs.mapInArrow(_sign(k, places), "id bigint, n bigint, d1 bigint, d2 bigint, sig binary")
    seen = staged(seen.withColumn("r", F.monotonically_increasing_id()), "signatures")
    base = seen.select("id", "n", "d1", "d2")
    # a class is named by the row of its first signature
    classes = staged(
        seen.filter("n > 0 and id is not null")
        .groupBy("d1", "d2")
        .agg(F.min(F.when(F.col("sig").isNotNull(), F.col("r"))).alias("c"), F.min("id").alias("rep")),
        "classes",
    )
    signed = seen.filter("sig is not null").select(F.col("r").alias("c"), "sig")
    signed = staged(signed.join(classes.select("c"), "c"), "classes")
    entries = staged(signed.mapInArrow(_bands(bands, rows), "band bigint, c bigint"), "bands")
    # stored sides of joins on keys that may be hot: Spark can split the other side
    centres = staged(entries.groupBy("band").agg(F.min("c").alias("centre"), F.count("*").alias("g")).filter("g > 1").drop("g"), "centres")
    pairs = staged(entries.join(centres, "band").filter("c <> centre").select("c", "centre").distinct(), "stars")
    met = staged(pairs.select(F.explode(F.array("c", "centre")).alias("c")).distinct(), "met")
    wanted = staged(classes.join(met, "c").select("c", "d1", "d2"), "wanted")
    sets = docs.mapInArrow(_sets(k, KeyFilter(wanted, "d1")), "d1 bigint, d2 bigint, grams binary")
    sets = staged(sets.join(wanted, ["d1", "d2"]).select("c", "grams").dropDuplicates(["c"]), "sets")
    signed = staged(signed.join(met, "c"), "signed")

    close = staged(_work(_stars(pairs, "centre", "c"), [signed], _prune(percent, miss, steps)), "close")
    links = staged(_work(_stars(close, "a", "b"), [sets], _confirm(percent)), "links")
    # members that are not linked to their centre against all of its group
    hit = links.select(F.col("a").alias("centre"), F.col("b").alias("c"), F.lit(True).alias("hit"))
    rest = staged(pairs.join(hit, ["centre", "c"], "left").select("centre", "c", F.col("hit").isNull().alias("miss")), "rest")
    sizes = rest.groupBy("centre").agg(F.count("*").alias("g"), F.sum(F.col("miss").cast("long")).alias("u")).filter("g > 1 and u > 0")
    rest = rest.join(staged(sizes, "sizes"), "centre").withColumns({"nu": _chunks("u"), "ng": _chunks("g")})
    i, j = F.pmod(F.hash("c"), F.col("nu")), F.pmod(F.hash("c"), F.col("ng"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = (
        rest.filter("miss").select("centre", i.alias("i"), every("ng").alias("j"), F.lit(0).alias("side"), "c")
        .unionByName(rest.select("centre", every("nu").alias("i"), j.alias("j"), F.lit(1).alias("side"), "c"))
        .select(F.xxhash64("centre", "i", "j").alias("task"), "side", "c")
    )
    near = _work(staged(blocks, "blocks"), [signed], _survivors(percent, miss, steps), "task bigint, side int, c bigint")
    links = links.unionByName(_work(staged(near, "near"), [signed, sets], _forest(percent, miss, steps)))
    # an id whose rows have different sets ties their classes together
    named = base.filter("n > 0 and id is not null").join(classes, ["d1", "d2"]).select("id", "c")
    ties = named.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("id", "a")
    ties = named.join(ties, "id").filter("a <> c").select("a", F.col("c").alias("b"))
    comp = components(links.unionByName(ties)).withColumnRenamed("id", "c")
    named = staged(classes.join(comp, "c", "left").withColumn("component", F.coalesce("component", "c")), "named")
    least = staged(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    labels = staged(named.join(least, "component").select("d1", "d2", "least"), "labels")
    out = base.join(labels, ["d1", "d2"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        "d1",
        "d2",
    )
