"""Token counts of whole texts; huge texts are encoded in overlapping chunks.

A text over ``CHUNK`` bytes is cut into chunks that overlap, and the chunks
are dealt to tasks. Two neighbours are spliced at a token that both encodings
give at the same bytes. Such a place is proven stable: a token sequence is the
merge encoding of its text if each adjacent pair is what merging the pair's
own text gives, and every pair of the spliced sequence stands side by side in
one of the two encodings. Texts for which some overlap has no common token
are done again with wider overlaps and chunks; one chunk needs no splice, so
this ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import staged, unused, with_columns

CHUNK = 1 << 16  # bytes
OVERLAP = 512  # bytes
WIDEN = 8
LIMIT = 4096


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _short(path: str, at: int):
    """Adds the number of tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = [x or "" for x in part.column(at).to_pylist()]
                n = [len(x) for x in sp.encode(texts, num_threads=1)]
                cols = {c: part.column(i) for i, c in enumerate(part.schema.names) if c != "n_tokens"}
                cols["n_tokens"] = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def cuts(raw: bytes, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk, at code point borders; neighbours share ``overlap`` bytes or more."""

    if chunk < 4:
        raise ValueError("a chunk must hold any code point")

    def border(at: int, way: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += way
        return at

    out, start = [], 0
    while True:
        # ends are moved on and starts back, so that a start lies behind the one before
        end = border(start + chunk + overlap, 1) if start + chunk + 2 * overlap < len(raw) else len(raw)
        out.append((start, end))
        if end == len(raw):
            return out
        start = border(end - overlap, -1)


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py().encode()
                spans = cuts(raw, chunk, overlap)
                for no, (lo, hi) in enumerate(spans):
                    row = [[b.column(0)[i].as_py()], [no], [len(spans)], [lo], [raw[lo:hi].decode()], [spans[no - 1][1] if no else -1], [spans[no + 1][0] if no + 1 < len(spans) else -1]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "no", "of", "start", "text", "head_to", "tail_from"])

    return run


def offsets(sp, text: str, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (bytes of the whole text) and id of each token of a chunk."""
    pieces = sp.encode(text, return_type="proto").pieces
    n = len(pieces)
    begin = np.fromiter((p.begin for p in pieces), np.int64, n) + start
    end = np.fromiter((p.end for p in pieces), np.int64, n) + start
    return begin, end, np.fromiter((p.id for p in pieces), np.int64, n)


def _margins(path: str):
    """Each chunk's number of tokens and its tokens in the two overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                begin, end, ids = offsets(sp, r["text"], r["start"])
                width = end > begin
                head = np.flatnonzero(width & (end <= r["head_to"]))
                tail = np.flatnonzero(width & (begin >= r["tail_from"])) if r["tail_from"] >= 0 else head[:0]
                out.append([r["key"], r["no"], r["of"], len(ids)] + [v[s].tolist() for s in (head, tail) for v in (np.arange(len(ids)), begin, end, ids)])
            names = ["key", "no", "of", "n", "hi", "hb", "he", "ht", "ti", "tb", "te", "tt"]
            longs = pa.list_(pa.int64())
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64()] + [longs] * 8
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    return run


def splice(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tokens of one text from its chunks' margins; null if a pair of neighbours shares no token."""
    pdf = pdf.sort_values("no")
    total, left, ok = 0, -1, len(pdf) == pdf["of"].iloc[0]
    rows = pdf.to_dict("records")
    for i, r in enumerate(rows):
        right, after = r["n"] - 1, -1
        if i + 1 < len(rows):
            nxt = rows[i + 1]
            there = {t: k for *t, k in zip(nxt["hb"], nxt["he"], nxt["ht"], nxt["hi"], strict=True) for t in [tuple(t)]}
            common = [(k, there[t]) for *t, k in zip(r["tb"], r["te"], r["tt"], r["ti"], strict=True) for t in [tuple(t)] if t in there]
            if not common:
                ok = False
                break
            right, after = common[len(common) // 2]
        total += right - left
        left = after
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "tokens": pd.array([total if ok else None], "Int64")})


def long_counts(texts: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """(key, tokens) of (key, text) by chunks, widening the overlaps where they do not align."""
    done = None
    while True:
        rows = texts.mapInArrow(_chunks(chunk, overlap), "key string, no int, of int, start bigint, text string, head_to bigint, tail_from bigint")
        lists = ", ".join(f"{c} array<bigint>" for c in ("hi", "hb", "he", "ht", "ti", "tb", "te", "tt"))
        margins = rows.repartition("key", "no").mapInArrow(_margins(model), f"key string, no int, of int, n bigint, {lists}")
        got = staged(margins.groupBy("key").applyInPandas(splice, "key string, tokens bigint"), "counts")
        fine = got.filter("tokens is not null")
        done = fine if done is None else done.unionByName(fine)
        failed = got.filter("tokens is null").select("key")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def count_tokens(
    docs: DataFrame, model: str, limit: int = LIMIT, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """All columns of ``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Counts are those of the library for a merge-type sentencepiece model,
    without begin or end tokens. Null and empty texts have 0 bytes and 0
    tokens. Texts are never cut short; equal long texts are encoded once.
    Columns of ``docs`` named like a result are replaced.
    """
    base = docs.drop("n_bytes", "n_tokens", "over_limit")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    at = base.columns.index(text_col)
    short = base.filter(size <= chunk).mapInArrow(_short(model, at), with_columns(base, "n_tokens bigint"))
    name = unused(base, "__key")
    key = F.sha2(text_col, 256)
    long = base.filter(size > chunk)
    texts = long.select(key.alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    counts = long_counts(texts, model, chunk, overlap).select(F.col("key").alias(name), F.col("tokens").alias("n_tokens"))
    long = long.withColumn(name, key).join(counts, name).drop(name)
    both = short.unionByName(long)
    return both.select(*base.columns, size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
