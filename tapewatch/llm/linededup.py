"""Line deduplication through sharded minimal perfect hashes.

The distinct line keys are dealt to shards by their hash. A shard holds one
minimal perfect hash over its keys, a level-by-level one: each level is a bit
array in which a bit is set where exactly one of the keys left falls, keys
that collide go to the next level, and the rank of a key's bit is its index.
The index leads to three flat arrays: a 64-bit fingerprint, the count of
documents (capped at 255, only ``>= 2`` matters) and the smallest doc_id.
Documents send hashes, never lines, to the shards and get back the hashes of
the lines they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import lean, staged, unused, with_columns
from .textscan import U64, Scan, ids_of, mix, text_batches

SHARD_KEYS = 250_000  # keys of one shard, about 6 MB of arrays
PROBE_ROWS = 500_000  # probes answered by one task
MIN_POINTS = 10
GAMMA = 2.0  # bits for each key of a level
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build_mph(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of packed bits for distinct 64-bit keys."""
    levels, left = [], keys
    while len(left):
        m = max(64, int(GAMMA * len(left)) // 8 * 8)
        at = (mix(left + U64(len(levels) * 0x51ED27)) % U64(m)).astype(np.int64)
        single = np.bincount(at, minlength=m) == 1
        levels.append(np.packbits(single))
        left = left[~single[at]]
    return levels


def lookup_mph(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Index of each key; -1 where no level has it (a foreign key may get any index)."""
    out = np.full(len(keys), -1, np.int64)
    todo, base = np.arange(len(keys)), 0
    for i, bits in enumerate(levels):
        ranks = np.concatenate([[0], np.cumsum(POP[bits], dtype=np.int64)])
        at = (mix(keys[todo] + U64(i * 0x51ED27)) % U64(len(bits) * 8)).astype(np.int64)
        byte, off = at >> 3, (at & 7).astype(np.uint8)
        hit = (bits[byte] >> (7 - off)) & 1 == 1
        before = POP[bits[byte[hit]] >> (8 - off[hit].astype(np.uint16)).astype(np.uint8)]
        out[todo[hit]] = base + ranks[byte[hit]] + before
        todo, base = todo[~hit], base + ranks[-1]
    return out


def line_keys(scan: Scan) -> tuple[np.ndarray, ...]:
    """Each line's start, end, text number, two hashes of its key, and whether the key is long enough."""
    start, end, doc = scan.lines()
    a, b = scan.stripped(start, end)
    return start, end, doc, scan.hashes(a, b), scan.hashes(a, b, 1), scan.code_points(a, b)


def both(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """One value of a key's two hashes."""
    return mix(h1) ^ h2


def _keys(min_points: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_batches(batches):
            _, _, doc, h1, h2, points = line_keys(Scan(texts))
            ids, null = ids_of(b)
            ok = (points >= min_points) & ~null[doc]
            d, h1, h2 = doc[ok], h1[ok], h2[ok]
            order = np.lexsort((h2, h1, d))
            d, h1, h2 = d[order], h1[order], h2[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            cols = [h1[new].view(np.int64), h2[new].view(np.int64), ids[d[new]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h1", "h2", "doc_id"])

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's arrays from its distinct keys."""
    h1 = pdf["h1"].to_numpy(np.int64).view(U64)
    # of keys with equal first hashes one is indexed; the others, hardly any, are listed beside the arrays
    h1, first = np.unique(h1, return_index=True)
    more = np.setdiff1d(np.arange(len(pdf)), first)
    extra = np.stack([pdf[c].to_numpy(np.int64)[more] for c in ("h1", "h2", "n", "owner")])
    levels = build_mph(h1)
    at = lookup_mph(levels, h1)
    finger, count, owner = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.uint8), np.zeros(len(h1), np.int64)
    finger[at] = pdf["h2"].to_numpy(np.int64)[first]
    count[at] = pdf["n"].to_numpy(np.int64)[first].clip(0, 255)
    owner[at] = pdf["owner"].to_numpy(np.int64)[first]
    return pd.DataFrame(
        {
            "shard": [pdf["shard"].iloc[0]],
            "sizes": [[len(x) for x in levels]],
            "levels": [np.concatenate(levels).tobytes()],
            "finger": [finger.tobytes()],
            "count": [count.tobytes()],
            "owner": [owner.tobytes()],
            "extra": [extra.tobytes()],
        }
    )


def _probe(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "line": pd.Series([], dtype="int64")})
    if not len(probes) or not len(shard):
        return out
    s = shard.iloc[0]
    levels = np.split(np.frombuffer(s["levels"], np.uint8), np.cumsum(s["sizes"])[:-1])
    finger, count = np.frombuffer(s["finger"], np.int64), np.frombuffer(s["count"], np.uint8)
    owner = np.frombuffer(s["owner"], np.int64)
    h1, doc = probes["h1"].to_numpy(np.int64), probes["doc_id"].to_numpy(np.int64)
    at = lookup_mph(levels, h1.view(U64))
    lost = (at >= 0) & (finger[at] == probes["h2"].to_numpy(np.int64)) & (count[at] >= 2) & (owner[at] != doc)
    h2 = probes["h2"].to_numpy(np.int64)
    for a, b, n, own in np.frombuffer(s["extra"], np.int64).reshape(4, -1).T:
        lost |= (h1 == a) & (h2 == b) & (n >= 2) & (doc != own)
    return pd.DataFrame({"doc_id": doc[lost], "line": both(h1.view(U64), h2.view(U64))[lost].view(np.int64)})


def _kept(names: list[str], text_at: int, min_points: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_batches(batches, text_at):
            scan = Scan(texts)
            start, end, doc, h1, h2, points = line_keys(scan)
            lists = b.column(b.num_columns - 1)
            lens = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            lens = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lens)
            gone = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.bincount(doc, minlength=len(texts))
            drop = np.zeros(len(doc), bool)
            if len(gone):
                own = np.repeat(np.arange(len(texts)), lens)
                # (text, hash) pairs as structured values, compared within the batch
                have = np.sort(mix(gone.view(U64) ^ mix(own.astype(U64))))
                want = mix(both(h1, h2) ^ mix(doc.astype(U64)))
                i = np.minimum(np.searchsorted(have, want), len(have) - 1)
                drop = (have[i] == want) & (points >= min_points)
            lost = np.bincount(doc[drop], minlength=len(texts))
            out: list[bytes] = list(texts)
            stop = np.cumsum(n)
            for t in np.flatnonzero(lost):
                own_lines = range(stop[t] - n[t], stop[t])
                o = scan.starts[t]
                out[t] = b"\n".join(texts[t][start[i] - o : end[i] - o] for i in own_lines if not drop[i])
            cols = {c: b.column(i) for i, c in enumerate(b.schema.names[:-1])}
            cols[names[0]] = pa.array(out, pa.binary()).cast(pa.string())
            cols[names[1]], cols[names[2]] = pa.array(n.astype(np.int64)), pa.array(lost.astype(np.int64))
            order = [c for c in cols if c not in names] + names
            yield pa.RecordBatch.from_arrays([cols[c] for c in order], order)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """Documents without the lines whose key another document with a smaller id holds.

    A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at
    both ends, A-Z lower-cased. Keys of fewer than ``min_points`` code points
    are never dropped. Returns all columns of ``docs`` with the text replaced,
    and ``n_lines`` (before dropping) and ``n_dropped``; columns that already
    have these names are replaced.

    Null text counts as empty: one empty line, and comes back as empty. Rows
    with null id neither lose lines nor make others lose theirs. Rows that
    repeat an id are one document. All lines may go: the text is then empty.
    """
    keys = staged(
        docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_keys(min_points), "h1 bigint, h2 bigint, doc_id bigint"),
        "linekeys",
    )
    distinct = staged(
        keys.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("owner"),
            F.when(F.min("doc_id") == F.max("doc_id"), 1).otherwise(F.count("*")).alias("n"),
        ),
        "linedistinct",
    )
    shards = max(1, -(-distinct.count() // SHARD_KEYS))
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")
    arrays = distinct.select("*", shard).groupBy("shard").applyInPandas(
        _build, "shard int, sizes array<int>, levels binary, finger binary, count binary, owner binary, extra binary"
    )
    probes = keys.select("*", shard)
    parts = probes.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("parts"))
    # a shard with a hot line has many probes: its arrays go to as many tasks as they need
    probes = probes.join(parts, "shard").withColumn("part", F.pmod(F.hash("doc_id"), F.col("parts")))
    spread = arrays.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lost = (
        probes.select("shard", "part", "h1", "h2", "doc_id").groupBy("shard", "part")
        .cogroup(spread.drop("parts").groupBy("shard", "part"))
        .applyInPandas(_probe, "doc_id bigint, line bigint")
    )
    # one document's lines only: no longer than its text
    base = docs.drop("n_lines", "n_dropped")
    key, gone = unused(base, "__id"), unused(base, "__gone")
    mine = lost.groupBy("doc_id").agg(F.collect_list("line").alias(gone)).withColumnRenamed("doc_id", key)
    names = [text_col, "n_lines", "n_dropped"]
    joined = base.join(mine, F.col(id_col).cast("bigint") == F.col(key), "left").drop(key)
    schema = with_columns(base, f"{text_col} string, n_lines bigint, n_dropped bigint")
    return joined.mapInArrow(_kept(names, base.columns.index(text_col), min_points), schema)


