"""Nearest neighbours with a navigable small-world graph for each shard.

Equal vectors are indexed once, with the few smallest ids of their rows. The
distinct vectors are dealt to shards of bounded size by hash. Each shard's
graph is hierarchical: a node is in level l with probability M**-l, and its
links in a level are chosen from its nearest nodes there so that no chosen
node is nearer to another chosen one than to the node itself; links are also
kept in the other direction while there is room. A graph is stored as flat
arrays of neighbour numbers. Close groups larger than the choice of links leave
the lowest level in islands, so a search starts in many of them: each island
has a node among the entries, and the beam begins with the entries nearest to
the query and the nearest one of each of its nearest islands. Every query goes through every shard's graph, a
block of queries in step, and the shards' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .tables import staged

SHARD_ROWS = 8192
LINKS = 16  # in upper levels; twice as many in the lowest
NEAR = 64  # nearest nodes from which links are chosen
BEAM = 128
START = 32  # nearest entries, and nearest islands, from which a beam starts
QUERIES = 256  # searched in step
SEED = 11


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k nearest other rows of each row, nearest first, and squared distances."""
    n = len(x)
    k = min(k, n - 1)
    sq = np.einsum("ij,ij->i", x, x)
    at, dist = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for lo in range(0, n, 512):
        d = sq[lo : lo + 512, None] + sq[None, :] - 2 * (x[lo : lo + 512] @ x.T)
        m = np.arange(len(d))
        d[m, m + lo] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        dn = np.take_along_axis(d, near, 1)
        order = np.argsort(dn, axis=1, kind="stable")
        at[lo : lo + len(d)] = np.take_along_axis(near, order, 1)
        dist[lo : lo + len(d)] = np.take_along_axis(dn, order, 1)
    return at, dist


def links(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbour numbers of one level's nodes, -1 where there are fewer than ``most``."""
    n = len(x)
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    at, dist = nearest(x, NEAR)
    k = at.shape[1]
    chosen = np.zeros((n, k), bool)
    for lo in range(0, n, 256):
        c = x[at[lo : lo + 256]]
        sq = np.einsum("ijk,ijk->ij", c, c)
        between = sq[:, :, None] + sq[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
        ok = np.zeros(c.shape[:2], bool)
        for j in range(k):
            blocked = (ok & (between[:, j, :] < dist[lo : lo + 256, j, None])).any(1)
            ok[:, j] = ~blocked & (ok.sum(1) < most // 2)
        chosen[lo : lo + 256] = ok
    src, col = np.nonzero(chosen)
    dst, d = at[src, col], dist[src, col]
    # own links first, then links from others, nearest first, while there is room
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.lexsort((np.concatenate([d, d]), np.repeat([0, 1], len(src)), a))
    a, b = a[order], b[order]
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
    keep = np.sort(first)
    a, b = a[keep], b[keep]
    start = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - start[a]
    fit = rank < most
    out[a[fit], rank[fit]] = b[fit]
    return out


def build(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Node numbers and neighbour arrays (in node numbers of the shard) of each level, lowest first."""
    level = np.floor(-np.log(1 - np.random.default_rng(SEED).random(len(x))) / np.log(LINKS)).astype(int)
    nodes, graph = [], []
    for l in range(level.max() + 1):
        own = np.flatnonzero(level >= l)
        nb = links(x[own], LINKS * (2 if l == 0 else 1))
        nodes.append(own.astype(np.int32))
        graph.append(np.where(nb >= 0, own[np.maximum(nb, 0)], -1).astype(np.int32))
    return nodes, graph


def islands(nb: np.ndarray) -> np.ndarray:
    """For each node the smallest node of its island, the nodes it reaches by links that go in both directions."""
    n = len(nb)
    src, col = np.nonzero(nb >= 0)
    dst = nb[src, col].astype(np.int64)
    both = np.isin(src * n + dst, dst * n + src)
    src, dst = src[both], dst[both]
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, src, low[dst])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def entries(nodes: list[np.ndarray], graph: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes a search can start from, ordered by island, and where each island's begin."""
    island = islands(graph[0])
    first = np.unique(island, return_index=True)[1]
    own = np.unique(np.concatenate([first, *nodes[1:2]]))
    own = own[np.argsort(island[own], kind="stable")]
    return own, np.flatnonzero(np.diff(island[own], prepend=-1))


def starts(x: np.ndarray, own: np.ndarray, begin: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query START nearest entries and the nearest ones of START islands (one may come twice)."""
    e = x[own]
    d = np.einsum("ij,ij->i", e, e)[None, :] - 2 * (q @ e.T)
    k = min(START, len(own))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    low = np.minimum.reduceat(d, begin, axis=1)
    k = min(START, len(begin))
    isle = np.argpartition(low, k - 1, axis=1)[:, :k]
    stop = np.append(begin[1:], len(own))
    best = [[begin[i] + d[r, begin[i] : stop[i]].argmin() for i in row] for r, row in enumerate(isle)]
    return own[np.concatenate([near, np.array(best, np.int64)], 1)]


def search(x: np.ndarray, nodes: list[np.ndarray], graph: list[np.ndarray], q: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers in each query's beam (-1: none), in no order."""
    nq, rows = len(q), np.arange(len(q))

    def far(at):
        diff = x[at] - q[:, None, :]
        return np.einsum("ijk,ijk->ij", diff, diff)

    cur = np.full(nq, nodes[-1][0], np.int64)
    best = far(cur[:, None])[:, 0]
    for l in range(len(nodes) - 1, 0, -1):
        place = np.full(len(x), -1, np.int64)
        place[nodes[l]] = np.arange(len(nodes[l]))
        while True:
            nb = graph[l][place[cur]]
            d = np.where(nb >= 0, far(np.maximum(nb, 0)), np.inf)
            j = d.argmin(1)
            better = d[rows, j] < best
            if not better.any():
                break
            cur, best = np.where(better, nb[rows, j], cur), np.where(better, d[rows, j], best)
    beam = min(beam, len(x))
    at = np.sort(np.concatenate([cur[:, None], starts(x, *entries(nodes, graph), q)], 1), axis=1)
    d = np.where(np.diff(at, axis=1, prepend=-1) == 0, np.inf, far(at)).astype(np.float32)
    first = np.argsort(d, axis=1, kind="stable")[:, :beam]
    at, d = np.take_along_axis(at, first, 1), np.take_along_axis(d, first, 1)
    ids, dist, done = np.full((nq, beam), -1, np.int64), np.full((nq, beam), np.inf, np.float32), np.zeros((nq, beam), bool)
    ids[:, : at.shape[1]], dist[:, : at.shape[1]] = np.where(np.isfinite(d), at, -1), d
    seen = np.zeros((nq, len(x)), bool)
    seen[rows[:, None], at] = True
    while True:
        open_ = np.where(done | (ids < 0), np.inf, dist)
        j = open_.argmin(1)
        live = np.isfinite(open_[rows, j])
        if not live.any():
            return ids
        done[rows[live], j[live]] = True
        nb = graph[0][np.where(live, ids[rows, j], 0)].astype(np.int64)
        ok = live[:, None] & (nb >= 0)
        ok &= ~np.take_along_axis(seen, np.maximum(nb, 0), 1)
        r, c = np.nonzero(ok)
        seen[r, nb[r, c]] = True
        d = np.where(ok, far(np.maximum(nb, 0)), np.inf).astype(np.float32)
        ids, dist = np.concatenate([ids, np.where(ok, nb, -1)], 1), np.concatenate([dist, d], 1)
        done = np.concatenate([done, np.zeros(nb.shape, bool)], 1)
        keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        ids, dist, done = (np.take_along_axis(v, keep, 1) for v in (ids, dist, done))


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("first")
    x = np.stack(pdf["vec"].to_numpy()).astype(np.float32)
    nodes, graph = build(x)
    ids = pdf["ids"].tolist()
    return pd.DataFrame(
        {
            "dim": [pdf["dim"].iloc[0]],
            "shard": [pdf["shard"].iloc[0]],
            "x": [x.tobytes()],
            "nodes": [[v.tobytes() for v in nodes]],
            "graph": [[v.tobytes() for v in graph]],
            "ids": [np.concatenate([np.asarray(v, np.int64) for v in ids]).tobytes()],
            "n_ids": [np.array([len(v) for v in ids], np.int64).tobytes()],
        }
    )


def _search(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                x = np.frombuffer(r["x"], np.float32).reshape(-1, r["dim"])
                nodes = [np.frombuffer(v, np.int32) for v in r["nodes"]]
                graph = [np.frombuffer(v, np.int32).reshape(len(n), -1) for v, n in zip(r["graph"], nodes, strict=True)]
                n_ids = np.frombuffer(r["n_ids"], np.int64)
                ids, stop = np.frombuffer(r["ids"], np.int64), np.cumsum(n_ids)
                q = np.array([v["vec"] for v in r["queries"]], np.float32)
                out: list[tuple] = []
                for lo in range(0, len(q), QUERIES):
                    got = search(x, nodes, graph, q[lo : lo + QUERIES], beam)
                    for row, near in enumerate(got):
                        near = near[near >= 0]
                        diff = x[near].astype(np.float64) - q[lo + row].astype(np.float64)
                        score = np.sqrt((diff * diff).sum(1))
                        # rows with equal vectors share the distance
                        own = np.concatenate([ids[stop[v] - n_ids[v] : stop[v]] for v in near])
                        score = np.repeat(score, n_ids[near])
                        top = np.lexsort((own, score))[:k]
                        out += [(r["queries"][lo + row]["no"], int(own[t]), float(score[t])) for t in top]
                cols = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["no", "vec_id", "score"])

    return run


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    beam: int = BEAM,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query.

    ``queries`` has the columns of ``vectors``. Score is the Euclidean distance
    in double precision; ties go to the smaller id. Rows with the query's id
    are left out. Vectors that are null, zero, empty or hold null or infinite
    values or NaN take no part, nor do rows with null id; vectors are compared
    with those of the same length. Fewer candidates than k give fewer rows.
    """

    def clean(df):
        v = F.col(vec_col).cast("array<float>")
        bad = F.exists("vec", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        d = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vec"))
        return d.filter("id is not null and vec is not null").filter(~bad & F.exists("vec", lambda e: e != 0))

    # one of two equal zeros would split a group of equal vectors
    norm = F.transform("vec", lambda e: F.when(e == 0, F.lit(0.0).cast("float")).otherwise(e))
    rows = clean(vectors).withColumn("vec", norm)
    # k rows and the query's own: the smallest ids of equal vectors are enough
    few = rows.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 1)
    kinds = staged(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vec")), "vectors")
    shards = {r.dim: -(-r.n // shard_rows) for r in kinds.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not shards:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n_shards = F.element_at(F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]), F.col("dim"))
    dealt = kinds.select("dim", F.pmod(F.xxhash64("vec"), n_shards).cast("int").alias("shard"), "vec", "ids", F.element_at("ids", 1).alias("first"))
    graphs = dealt.groupBy("dim", "shard").applyInPandas(
        _graph, "dim int, shard int, x binary, nodes array<binary>, graph array<binary>, ids binary, n_ids binary"
    )
    asked = clean(queries).withColumn("vec", norm).withColumn("no", F.xxhash64("vec", F.lit(1)))
    blocks = max(1, -(-asked.select("no").distinct().count() // QUERIES))
    asked_once = asked.groupBy("no").agg(F.first("vec").alias("vec")).withColumn("dim", F.size("vec"))
    block = F.pmod(F.xxhash64("no"), F.lit(blocks)).alias("block")
    packed = asked_once.filter(n_shards.isNotNull()).groupBy("dim", block).agg(F.collect_list(F.struct("no", "vec")).alias("queries"))
    pairs = packed.select("dim", "queries", F.explode(F.sequence(F.lit(0), n_shards.cast("int") - 1)).alias("shard"))
    found = pairs.join(graphs, ["dim", "shard"]).mapInArrow(_search(k + 1, beam), "no bigint, vec_id bigint, score double")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("no").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    mine = asked.select("no", F.col("id").alias("query_id")).join(best, "no").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return mine.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
