"""Exact Jaccard join of documents on word n-grams by blocked incidence products.

The documents are the rows and the distinct n-grams the columns of a sparse
0/1 matrix A; the overlaps wanted are entries of A times its transpose. Three
bounds derived from set sizes keep almost all of that product from being made.

* **Column blocks.** Sets a, b (a <= b) with Jaccard >= t differ in at most
  k = a (1-t) / t columns. If the columns are dealt to k + 1 + e blocks by
  hash, both rows are identical in more than e of them. So only rows that
  agree in a whole column block meet. ``e`` covers blocks that say nothing:
  empty ones, and ones made of very common n-grams alone; rows with more than
  ``e`` of those use them all the same, so that no pair is lost. A row with
  fewer such blocks, say i, agrees with a linked row in at least e + 1 - i of
  its others: rows that have company in fewer are linked with nothing and go.
* **Size bands.** Linked rows lie in the same or in neighbouring bands of
  sizes with ratio 1/t; each row is entered for its own band and the one below.
* **Row blocks.** Rows that meet are multiplied as blocks of about
  ``BLOCK`` rows or ``BLOCK_BYTES`` over their common columns, a slice of columns at a time; a
  pair is discarded when its overlap so far and the columns that are left
  cannot reach ceil(t (a+b) / (1+t)).

For components not all pairs of a group are needed. Each group's centre, the
row with the most company, is multiplied with the others first: of many near
copies that is one close to most of them. Rows that these links join to it need
no product among themselves, and only the others are multiplied with the whole
group. Of the links found then a block returns those that join more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .tables import KeyFilter, lean, runs, slices, staged
from .textscan import U64, Scan, ids_of, mix, shingle_sets, text_batches

CHUNK = 1_000_000  # n-grams or block entries combined before they leave a task
BLOCK = 1024  # rows of one side of a block product
BLOCK_BYTES = 16 << 20  # and their n-grams
COLUMNS = 4096  # columns multiplied at once
COMMON_SHARE = 2000  # an n-gram in more than one of so many documents is common
COMMON_MOST = 1 << 16  # common n-grams sent to tasks (512 KB); any choice gives the same result


class Bands:
    """Size bands and the number of column blocks of each, for threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 33:
            self.low.append(self.low[-1] * den // num + 1)
        self.low = np.array(self.low)
        most = np.append(self.low[1:], self.low[-1] * 2) - 1
        self.differ = most * (den - num) // num
        blocks = self.differ + 1
        for _ in range(4):
            idle = blocks * np.exp(-self.low / blocks)
            blocks = self.differ + 1 + np.ceil(2 * idle + 6 * np.sqrt(idle) + 2).astype(np.int64)
        self.blocks = blocks

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of these sizes."""
        return -((-self.num * (a + b)) // (self.num + self.den))


def _distinct_texts(batches, k: int, seed: int) -> Iterator[tuple]:
    """(ids, nulls, sizes, digests, text number, n-gram); a task's second copy of a set has no n-grams."""
    salt = mix(np.array([seed], U64))
    seen: set[tuple[int, int]] = set()
    for b, texts in text_batches(batches):
        d, s = shingle_sets(Scan(texts), k)
        n = np.bincount(d, minlength=len(texts))
        with np.errstate(over="ignore"):
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            some = n > 0
            d1, d2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            if len(s):
                d1[some] = np.add.reduceat(mix(s ^ U64(0xA5A5A5A5) ^ salt), at[some])
                d2[some] = np.add.reduceat(mix(s ^ U64(0x5A5A5A5A5A) ^ salt), at[some])
        ids, null = ids_of(b)
        fresh = np.zeros(len(n), bool)
        for i in np.flatnonzero(some & ~null):
            key = (int(d1[i]), int(d2[i]))
            if key not in seen:
                seen.add(key)
                fresh[i] = True
        keep = fresh[d]
        yield ids, null, n, d1.view(np.int64), d2.view(np.int64), d[keep], s[keep]


def _rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    n = len(cols[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), *(c if isinstance(c, pa.Array) else pa.array(np.asarray(c, np.int64)) for c in cols)],
        ["kind", "a", "n", "d1", "d2"],
    )


def _base(k: int, seed: int):
    """Documents (kind 0: id, size, digest) and n-grams common in a task's part (kind 1: n-gram, count)."""

    @lean
    def run(batches):
        held, size, docs = [], 0, 0

        def common():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(4, docs // 500)
            z = np.zeros(int(often.sum()))
            return _rows(1, t[often].view(np.int64), c[often], z, z)

        for ids, null, n, d1, d2, d, s in _distinct_texts(batches, k, seed):
            yield _rows(0, pa.array(ids, pa.int64(), mask=null), n, d1, d2)
            held.append(s)
            size, docs = size + len(s), docs + len(n)
            if size >= 4 * CHUNK:
                yield common()
                held, size, docs = [], 0, 0
        if held:
            yield common()

    return run


def _entries(k: int, seed: int, bands: Bands, common: np.ndarray, repeats: bool):
    """(entry, class) of every column block of every class's set; an entry's last bit is that of its band.

    Of the rows of a chunk that share an entry the smallest has to meet other
    parts; it is given twice, which tells that there are others. With
    ``repeats`` the others are given instead, and for each class and band (its
    last bit as ``sig``) how many entries a linked class has in common with it
    at least (``need``). Both need the same chunks, so the documents must be
    read in the same order each time.
    """

    def part(sigs, docs, needs=()):
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        sigs.clear(), docs.clear()
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        del order
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        if not repeats:
            again = np.append(~first[1:], False)
            at = np.repeat(np.flatnonzero(first), 1 + again[first])
            return slices(["sig", "c"], sig[at].view(np.int64), doc[at])
        at = np.flatnonzero(~first)
        bit, who, need = (np.concatenate(x) for x in zip(*needs, strict=True))
        need = np.ma.array(np.concatenate([np.zeros(len(at), np.int64), need]), mask=np.arange(len(at) + len(need)) < len(at))
        return slices(["sig", "c", "need"], np.concatenate([sig[at].view(np.int64), bit]), np.concatenate([doc[at], who]), need)

    @lean
    def run(batches):
        sigs, docs, needs, size = [], [], [], 0
        for _, _, n, d1, _, d, s in _distinct_texts(batches, k, seed):
            if not len(s):
                continue
            if len(common):
                i = np.minimum(np.searchsorted(common, s), len(common) - 1)
                rare = common[i] != s
            else:
                rare = np.ones(len(s), bool)
            value, place = mix(s ^ U64(0x1234567)), mix(s ^ U64(0x89ABCDEF))
            low, high = (value & U64(0xFFFFFFFF)).astype(np.float64), (value >> U64(32)).astype(np.float64)
            used = np.flatnonzero(np.bincount(d, minlength=len(n)))
            own = bands.of(n)
            for below in (0, 1):
                band = own - below
                ok = np.zeros(len(n), bool)
                ok[used] = band[used] >= 0
                ok[used] &= bands.differ[np.maximum(band[used], 0)] > 0
                m = np.where(ok, bands.blocks[np.maximum(band, 0)], 0)
                base = np.concatenate([[0], np.cumsum(m)])
                sel = ok[d]
                at = base[d[sel]] + (place[sel] % m[d[sel]].astype(U64)).astype(np.int64)
                total = int(base[-1])
                if not total:
                    continue
                lo, hi = np.bincount(at, low[sel], total).astype(U64), np.bincount(at, high[sel], total).astype(U64)
                strong = np.bincount(at[rare[sel]], minlength=total) > 0
                row = np.repeat(np.arange(len(n)), m)
                idle = np.bincount(row[~strong], minlength=len(n))
                spare = m - bands.differ[np.maximum(band, 0)]
                use = strong | (idle >= spare)[row]
                with np.errstate(over="ignore"):
                    where = mix(band[row].astype(U64) * U64(1 << 32) + (np.arange(total) - base[row]).astype(U64))
                    sig = mix((lo + (hi << U64(32))) ^ where)
                sig = (sig & ~U64(1)) | (band[row] & 1).astype(U64)
                sigs.append(sig[use])
                docs.append(d1[row[use]])
                size += len(sigs[-1])
                # a class that also uses its idle blocks may agree with others in one of them alone
                few = np.flatnonzero(ok & (idle < spare))
                needs.append((band[few] & 1, d1[few], (spare - idle)[few]))
            if size >= CHUNK:
                yield from part(sigs, docs, needs)
                sigs, docs, needs, size = [], [], [], 0
        if size:
            yield from part(sigs, docs, needs)

    return run


@lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries held by several rows.

    Input: one partition of the entries dealt by hash, at most two rows for
    each entry and part, so no entry has more rows here than twice the parts.
    """
    cols = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not cols:
        return
    sig, doc = (np.concatenate(c) for c in zip(*cols, strict=True))
    del cols
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    del order
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(sig)))
    keep = np.repeat(size > 1, size)
    keep[1:] &= (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
    yield from slices(["sig", "c"], sig[keep], doc[keep])


def _sets(k: int, seed: int, wanted: KeyFilter):
    """(class, n-grams) of the rows that may be of a wanted class, each set once a task."""

    @lean
    def run(batches):
        for _, _, n, d1, _, d, s in _distinct_texts(batches, k, seed):
            size = np.bincount(d, minlength=len(n))
            at = np.flatnonzero((size > 0) & wanted.may_hold(d1))
            stop = np.cumsum(size)
            raw = [s[stop[i] - size[i] : stop[i]].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(raw, pa.binary())], ["c", "grams"])

    return run


def block_product(left: list[np.ndarray], right: list[np.ndarray], bands: Bands, asked: np.ndarray | None = None) -> np.ndarray:
    """Which rows of ``left`` and ``right`` (sorted n-gram sets) reach the threshold, as a mask; of the pairs ``asked``, if given."""
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    need = bands.need(nl[:, None], nr[None, :])
    alive = np.minimum(nl[:, None], nr[None, :]) >= need
    if asked is not None:
        alive &= asked
    cl, cr = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(np.unique(cl), np.unique(cr), assume_unique=True)
    over = np.zeros(alive.shape, np.float32)
    if not len(columns):
        return alive & (need <= 0)

    def entries(values, sizes):
        i = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        hit = columns[i] == values
        return np.repeat(np.arange(len(sizes)), sizes)[hit], i[hit]

    (rl, il), (rr, ir) = entries(cl, nl), entries(cr, nr)
    left_over, right_over = np.bincount(rl, minlength=len(nl)), np.bincount(rr, minlength=len(nr))
    for lo in range(0, len(columns), COLUMNS):
        # columns still to come bound what a pair can gain
        alive &= over + np.minimum(left_over[:, None], right_over[None, :]) >= need
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            break
        w = min(COLUMNS, len(columns) - lo)
        a, b = np.zeros((len(nl), w), np.float32), np.zeros((len(nr), w), np.float32)
        sl, sr = (il >= lo) & (il < lo + w), (ir >= lo) & (ir < lo + w)
        a[rl[sl], il[sl] - lo] = 1
        b[rr[sr], ir[sr] - lo] = 1
        over[np.ix_(rows, cols)] += a[rows] @ b[cols].T
        left_over, right_over = left_over - np.bincount(rl[sl], minlength=len(nl)), right_over - np.bincount(rr[sr], minlength=len(nr))
    return alive & (over >= need)


def _products(bands: Bands):
    @lean
    def run(batches):
        for t in runs(batches):
            side = t.column("side").to_numpy()
            ids = t.column("c").to_numpy()
            grams = [np.frombuffer(x, U64) for x in t.column("grams").to_pylist()]
            li, ri = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(li) or not len(ri):
                continue
            x, y = np.nonzero(block_product([grams[i] for i in li], [grams[i] for i in ri], bands))
            a, b = ids[li[x]], ids[ri[y]]
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _forest(bands: Bands):
    """Links between the groups (``c`` holds their names) of a block's rows that join these as all links do.

    A pair that is already joined is not multiplied, so no block returns more
    links than it has rows.
    """

    @lean
    def run(batches):
        for t in runs(batches):
            side = t.column("side").to_numpy()
            names, group = np.unique(t.column("c").to_numpy(), return_inverse=True)
            grams = [np.frombuffer(x, U64) for x in t.column("grams").to_pylist()]
            li, ri = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            asked = group[li][:, None] != group[ri][None, :]
            if not asked.any():
                continue
            mask = block_product([grams[i] for i in li], [grams[i] for i in ri], bands, asked)
            join = np.arange(len(names))
            a, b = [], []
            for i in np.flatnonzero(mask.any(1)):
                own = join[group[li[i]]]
                new = np.unique(join[group[ri[mask[i]]]])
                new = new[new != own]
                a.append(np.full(len(new), own))
                b.append(new)
                join[np.isin(join, new)] = own
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(names[np.concatenate(x)]) for x in (a, b)], ["a", "b"])

    return run


def _linked(tasks: DataFrame, sets: DataFrame, work) -> DataFrame:
    """Links (a, b) that ``work`` finds in the blocks of ``tasks`` (task, side, c; with ``g``, the name of c's group, that counts as name)."""
    name = F.col("g" if "g" in tasks.columns else "c").alias("c")
    rows = tasks.join(sets, "c").select("task", "side", name, "grams")
    rows = rows.repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(work, "a bigint, b bigint")


def _in_company(entries: DataFrame, needs: DataFrame) -> DataFrame:
    """Of the distinct (sig, c) those of classes that have other classes in as many entries of a band as a link needs.

    ``w``: the class's company, the rows of all its entries, in steps of a fifth.
    """
    for _ in range(2):
        several = staged(entries.groupBy("sig").agg(F.count("*").alias("g")).filter("g > 1"), "several")
        entries = entries.select("sig", "c").join(several, "sig").withColumn("bit", F.expr("sig & 1"))
        some = entries.groupBy("c", "bit").agg(F.count("*").alias("n"), F.sum("g").alias("w")).join(needs, ["c", "bit"], "left")
        some = staged(some.filter("n >= coalesce(need, 1)").select("c", "bit", "w"), "some")
        entries = staged(entries.join(some, ["c", "bit"]).select("sig", "c"), "company")
    # one weight for both bands of a class, and for classes nearly alike: so fewer different ones are chosen
    weights = some.groupBy("c").agg(F.floor(4 * F.log2(F.sum("w"))).alias("w"))
    return entries.join(staged(weights, "weights"), "c")


def _classes(docs: DataFrame, k: int) -> tuple[int, DataFrame, DataFrame]:
    """The digests' seed, what ``_base`` returns, and the classes: (c, rep) with the digest d1 as name.

    Two sets with one name differ in the second digest; then another seed is taken.
    """
    seed = 0
    while True:
        seen = staged(docs.mapInArrow(_base(k, seed), "kind int, a bigint, n bigint, d1 bigint, d2 bigint"), "sets")
        named = seen.filter("kind = 0 and n > 0").groupBy(F.col("d1").alias("c"))
        named = named.agg(F.min("a").alias("rep"), F.min("d2").alias("lo"), F.max("d2").alias("hi"))
        named = staged(named, "classes")
        if named.filter("lo <> hi").isEmpty():
            return seed, seen, named.filter("rep is not null").select("c", "rep")
        seed += 1


def _spread(rows: str, size: str) -> F.Column:
    return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents joined where 100 * intersection >= ``percent`` * union of their k-word shingles.

    Returns a row for each row of ``docs``: ``id_col``, ``n_shingles``, the
    digest of the set (``d1``, ``d2``: equal for equal sets) and
    ``component_id``, the smallest id reachable by links, itself included.

    A null text or one without words has an empty set, is linked with nothing
    and is its own component. A text of fewer than k words has its whole
    sequence as one shingle. An id with several rows has the links of all of
    them, and each row is returned; a row
    with null id joins the component of an equal set, and has a null
    component if there is none.
    """
    bands = Bands(percent, 100)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    seed, seen, classes = _classes(docs, k)
    base = seen.filter("kind = 0").select(F.col("a").alias("id"), "n", "d1", "d2")
    often = seen.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n"))
    least = max(8, base.count() // COMMON_SHARE)
    top = often.filter(F.col("n") >= least).orderBy(F.desc("n"), "a").limit(COMMON_MOST)
    common = np.sort(np.array([r.a for r in top.select("a").collect()], np.int64).view(U64))

    # entries are by far the most rows here: they are shuffled once and never stored
    entries = docs.mapInArrow(_entries(k, seed, bands, common, False), "sig bigint, c bigint")
    met = staged(entries.repartition("sig").mapInArrow(_meet, "sig bigint, c bigint"), "met")
    again = staged(docs.mapInArrow(_entries(k, seed, bands, common, True), "sig bigint, c bigint, need bigint"), "repeats")
    needs = again.filter("need is not null").select("c", F.col("sig").alias("bit"), "need").distinct()
    met = staged(met.unionByName(again.filter("need is null").select("sig", "c")).distinct(), "entries")
    met = _in_company(met, needs)
    # stored sides of joins on keys that may be hot: Spark can split the other side
    met = staged(met, "weighed")
    centres = staged(met.groupBy("sig").agg(F.max_by("c", F.struct("w", F.expr("~c"))).alias("centre")), "centres")
    pairs = staged(met.join(centres, "sig").filter("c <> centre").select("c", "centre").distinct(), "stars")
    wanted = staged(pairs.select(F.explode(F.array("centre", "c")).alias("c")).distinct(), "wanted")
    sets = docs.mapInArrow(_sets(k, seed, KeyFilter(wanted, "c")), "c bigint, grams binary")
    sets = staged(sets.join(wanted, "c").dropDuplicates(["c"]).withColumn("size", F.octet_length("grams")), "candidates")
    # the centre against its rows, in chunks
    pairs = staged(pairs.join(sets.select("c", "size"), "c"), "stars")
    sizes = staged(pairs.groupBy("centre").agg(F.count("*").alias("g"), F.sum("size").alias("sg")), "sizes")
    dealt = pairs.join(sizes, "centre").withColumn("chunk", F.pmod(F.hash("c"), _spread("g", "sg")))
    task = F.xxhash64("centre", "chunk").alias("task")
    tasks = dealt.select(task, F.lit(1).alias("side"), "c").unionByName(
        dealt.select(task, F.lit(0).alias("side"), F.col("centre").alias("c")).distinct()
    )
    stars = staged(_linked(tasks, sets, _products(bands)), "links")
    # an id whose rows have different sets ties their classes together
    named = base.filter("n > 0 and id is not null").select("id", F.col("d1").alias("c"))
    ties = named.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z").select("id", "a")
    ties = named.join(staged(ties, "ties"), "id").filter("a <> c").select("a", F.col("c").alias("b")).distinct()
    known = components(stars.unionByName(ties)).select(F.col("id").alias("c"), F.col("component").alias("g"))
    known = staged(pairs.select(F.explode(F.array("centre", "c")).alias("c")).distinct().join(known, "c", "outer").withColumn("g", F.coalesce("g", "c")), "known")
    # rows that no link joins to their centre against the others of its group
    rest = pairs.join(known, "c").join(known.select(F.col("c").alias("centre"), F.col("g").alias("own")), "centre")
    rest = staged(rest.withColumn("miss", F.col("g") != F.col("own")).drop("own").withColumnRenamed("g", "name"), "rest")
    sizes = rest.groupBy("centre").agg(
        F.count("*").alias("g"), F.sum("size").alias("sg"), F.count_if("miss").alias("u"), F.sum(F.when(F.col("miss"), F.col("size"))).alias("su")
    )
    sizes = staged(sizes.filter("g > 1 and u > 0"), "sizes")
    rest = rest.join(sizes, "centre").withColumns({"nu": _spread("u", "su"), "ng": _spread("g", "sg")})
    i, j = F.pmod(F.hash("c"), F.col("nu")), F.pmod(F.hash("c"), F.col("ng"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tasks = (
        rest.filter("miss").select("centre", i.alias("i"), every("ng").alias("j"), F.lit(0).alias("side"), "c", "name")
        .unionByName(rest.select("centre", every("nu").alias("i"), j.alias("j"), F.lit(1).alias("side"), "c", "name"))
        .select(F.xxhash64("centre", "i", "j", F.lit(2)).alias("task"), "side", "c", F.col("name").alias("g"))
    )
    more = components(_linked(staged(tasks, "blocks"), sets, _forest(bands))).withColumnRenamed("id", "g")
    comp = known.join(more, "g", "left").select("c", F.coalesce("component", "g").alias("component"))
    named = staged(classes.join(comp, "c", "left").withColumn("component", F.coalesce("component", "c")), "named")
    smallest = staged(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    labels = staged(named.join(smallest, "component").select(F.col("c").alias("d1"), F.col("least").alias("c")), "labels")
    out = base.join(labels, "d1", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("component_id"), "d1", "d2"
    )
