"""Hard negatives from shared candidate lists of anchor clusters.

Anchors are clustered by direction. All members of a cluster lie within an
angle b of its centre, so by the triangle inequality of angles no candidate
with norm r at angle t from the centre scores more than

    |anchor| * r * cos(max(0, t - b))

with any member. The candidates are sorted once for each cluster by the part
of this bound that does not depend on the member, and every member walks that
one list, a chunk at a time, until the bound of what is to come certifies that
nothing more can enter its result. The result is exact for any clusters;
good ones make the walks short.

The candidates are dealt to shards of about ``SHARD_ROWS`` rows and the
anchors to parts of about ``PART_ROWS``, each part clustered once; a task holds
one of each, sorts the shard for each cluster of the part and walks it.
Positives are merged over the shards first; the walks for negatives then know
each positive's range of scores and stop at its lower end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .tables import runs, staged

SHARD_ROWS = 4096
PART_ROWS = 8192
MEMBERS = 64  # anchors to a cluster, about
ROUNDS = 6  # of the clustering
CHUNK = 512  # candidates between two looks at the bound
SLACK = 1e-6  # of a candidate's norm: more than any rounding of the angles
LIMIT = 1 << 62


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Number of each row's cluster, of at most k; spherical k-means from spread-out rows."""
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    k = min(k, len(x))
    first = [0]
    near = unit @ unit[0]
    for _ in range(1, k):
        far = int(near.argmin())
        first.append(far)
        near = np.maximum(near, unit @ unit[far])
    centre = unit[first].copy()
    for _ in range(ROUNDS):
        own = (unit @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        size = np.linalg.norm(total, axis=1)
        some = size > 0
        centre[some] = total[some] / size[some, None]
    return (unit @ centre.T).argmax(1)


def shared_list(members: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the candidates ``x`` for a cluster, and the bound of each on score / |member|, falling."""
    size = np.linalg.norm(members, axis=1)
    centre = (members / np.where(size > 0, size, 1)[:, None]).sum(0)
    centre /= np.linalg.norm(centre) or 1

    def angles(v):
        norm = np.linalg.norm(v, axis=1)
        # a zero vector has every angle: it bounds nothing as a candidate and takes any place as a member
        return np.arccos(np.clip(v @ centre / np.where(norm > 0, norm, 1), -1, 1)), norm

    t, r = angles(x)
    width, own = angles(members)
    width = width[own > 0].max(initial=0.0)
    bound = r * (np.cos(np.maximum(0, t - width)) + SLACK)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as int64; float arithmetic only where it is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each of n slots, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, -LIMIT)  # the k-th best score; where it is missing, under all scores

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        last = np.flatnonzero(np.diff(np.append(self.slot, -1)) != 0)
        count = np.bincount(self.slot, minlength=self.n)
        whole = last[count[self.slot[last]] == self.k]
        self.floor[self.slot[whole]] = self.score[whole]


def walk(
    anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same_label: bool, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows (anchor, range, id, score) of each anchor and range of scores, and the number of products made.

    ``low`` and ``high`` hold, for each anchor, the ranges of scores wanted (inclusive).
    """
    ranges, made, parts = low.shape[1], 0, []
    exact, real = anchors["vec"], anchors["vec"].astype(np.float64)
    cand = rows["vec"].astype(np.float64)
    norm = np.linalg.norm(real, axis=1)
    for c in np.unique(anchors["cluster"]):
        own = np.flatnonzero(anchors["cluster"] == c)
        order, bound = shared_list(real[own], cand)
        best, live = Best(len(own) * ranges, k), np.arange(len(own))
        for lo in range(0, len(order), CHUNK):
            # a range is certain once no candidate left can reach its lower end or its k-th best
            members = own[live]
            reach = norm[members] * bound[lo] * (1 + 1e-9) + 1
            need = np.maximum(low[members], best.floor[live[:, None] * ranges + np.arange(ranges)])
            live = live[((need <= reach[:, None]) & (low[members] <= high[members])).any(1)]
            if not len(live):
                break
            members, at = own[live], order[lo : lo + CHUNK]
            score = products(exact[members], rows["vec"][at])
            made += score.size
            allowed = (rows["label"][at][None, :] == anchors["label"][members][:, None]) == same_label
            allowed &= rows["id"][at][None, :] != anchors["id"][members][:, None]
            for j in range(ranges):
                floor = np.maximum(low[members, j], best.floor[live * ranges + j])
                x, y = np.nonzero(allowed & (score >= floor[:, None]) & (score <= high[members, j][:, None]))
                best.add(live[x] * ranges + j, score[x, y], rows["id"][at[y]])
        parts.append((own[best.slot // ranges], best.slot % ranges, best.id, best.score))
    return *(np.concatenate(c) for c in zip(*parts, strict=True)), made


def _side(t: pa.Table, side: int) -> dict[str, np.ndarray]:
    t = t.filter(pc.equal(t.column("side"), side))
    vec = t.column("vec").combine_chunks()
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "key": t.column("key").to_numpy(),
        "id": t.column("id").to_numpy(),
        "label": t.column("label").to_numpy(),
        "cluster": t.column("cluster").to_numpy(),
        "vec": flat.reshape(len(vec), -1) if len(vec) else np.zeros((0, 0), np.int64),
        "wanted": t.column("wanted").to_pylist(),
    }


def _walks(k: int, mine: bool, low_pct: int, high_pct: int):
    """Walks of the tasks; ``mine`` for positives, else negatives for the positives' scores in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            a, rows = _side(t, 0), _side(t, 1)
            if not len(a["id"]) or not len(rows["id"]):
                continue
            if mine:
                low = np.full((len(a["id"]), 1), -LIMIT)
                high = -low
            else:
                ranges = max(len(v) for v in a["wanted"])
                # an empty range where an anchor has fewer positives
                low, high = np.full((len(a["id"]), ranges), 1), np.zeros((len(a["id"]), ranges), np.int64)
                for i, v in enumerate(a["wanted"]):
                    for j, s in enumerate(v):
                        low[i, j], high[i, j] = -(-low_pct * s // 100), high_pct * s // 100
            i, j, ids, score, _ = walk(a, rows, low, high, mine, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["key"][i]), pa.array(j.astype(np.int32)), pa.array(ids), pa.array(score)], ["key", "place", "id", "score"]
            )

    return run


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The clusters of the anchors, a part at a time."""
    for t in runs(batches):
        vec = t.column("vec").combine_chunks()
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
        own = pa.array(cluster(x, -(-len(x) // MEMBERS)).astype(np.int32))
        yield from t.append_column("cluster", own).to_batches()


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(key, id, label, vec, dim) of the rows that take part, components floor(``scale`` * x)."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v"))
    rows = rows.filter("id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    # products of such components cannot leave 64 bits
    top = F.sqrt(F.lit(float(LIMIT)) / F.size("v"))
    rows = rows.filter(F.forall("v", lambda e: F.abs(F.lit(float(scale)) * e) < top - 1))
    rows = rows.select("id", "label", F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e)).alias("vec"))
    rows = rows.distinct()
    return rows.select(F.xxhash64("id", "label", "vec").alias("key"), "id", "label", "vec", F.size("vec").alias("dim"))


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    k_pos: int = 5,
    k_neg: int = 5,
    low_pct: int = 80,
    high_pct: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    shard_rows: int = SHARD_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of the components floor(``scale`` * x), exact in
    64 bits. An anchor's positives are its ``k_pos`` best other rows of its
    label; the negatives of a positive are the ``k_neg`` best rows of other
    labels whose score lies between ``low_pct`` and ``high_pct`` percent of the
    positive's. Ties go to smaller ids; fewer rows give fewer results.

    ``anchors`` has the columns of ``vectors``. Rows with null id, label or
    vector, an empty vector, or a null, infinite or NaN component take no part,
    nor do rows whose components are so large that products could leave 64
    bits. Vectors are compared with those of the same length. Equal rows count
    once; rows that share an id but differ are rows of their own, of which an
    anchor never meets those with its own id. Other columns play no part.
    """
    rows = staged(quantised(vectors, id_col, vec_col, label_col, scale), "rows")
    asked = quantised(anchors, id_col, vec_col, label_col, scale)

    def number(df, per):
        found = {r.dim: -(-r.n // per) for r in df.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in found.items() for x in kv]), F.col("dim")), F.lit(0)) if found else F.lit(0)

    asked = staged(asked, "anchors")
    shards, parts = number(rows, shard_rows).cast("int"), number(asked, part_rows).cast("int")
    part = F.pmod(F.xxhash64("key", F.lit(1)), parts).cast("int").alias("part")
    asked = asked.select(part, "*").select(F.xxhash64("dim", "part").alias("of"), "*").repartition("of").sortWithinPartitions("of")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    asked = staged(asked.mapInArrow(_clusters, f"{ddl}, cluster int"), "clusters")
    dealt = rows.select(
        F.explode(F.when(parts > 0, F.sequence(F.lit(0), parts - 1))).alias("part"), F.pmod("key", shards).cast("int").alias("shard"), "*"
    )
    place = ("key", "id", "label", "vec", "cluster", "wanted")
    task = F.xxhash64("dim", "part", "shard").alias("task")
    nothing = F.array().cast("array<bigint>")
    side = dealt.withColumns({"cluster": F.lit(0), "wanted": nothing}).select(task, F.lit(1).alias("side"), *place)

    def walked(queries, mine):
        spread = queries.filter(shards > 0).select(F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "*")
        both = side.unionByName(spread.select(task, F.lit(0).alias("side"), *place))
        both = both.repartition("task").sortWithinPartitions("task")
        found = both.mapInArrow(_walks(k_pos if mine else k_neg, mine, low_pct, high_pct), "key bigint, place int, id bigint, score bigint")
        rank = F.row_number().over(W.partitionBy("key", "place").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= (k_pos if mine else k_neg))

    positives = staged(walked(asked.withColumn("wanted", nothing), True), "positives")
    ranges = positives.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    queries = staged(asked.join(ranges, "key").withColumn("wanted", F.transform("p", lambda p: p["score"])), "queries")
    negatives = walked(queries, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    out = negatives.join(queries.select("key", F.col("id").alias("anchor_id"), "p"), "key").withColumn("one", F.get("p", F.col("place")))
    return out.select(
        "anchor_id",
        F.col("one.id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        F.col("one.score").alias("positive_score"),
        "negative_score",
    )
