"""Token ids of documents in grammar-compressed shard files (Re-Pair).

A shard holds documents of a range of ids in ascending order. Its ids are one
sequence with the end id behind each document. Frequent pairs of neighbours
are replaced by new symbols, again and again: first inside the distinct words,
where one replacement counts for all occurrences of the word, then between
words and inside documents. Rules, the expansion length of every rule, and
the remaining symbols in blocks of whole documents are stored as Parquet rows,
so one document is read by its block, its shard's rules and its symbols.

Words are cut at white space, at which the tokenizer always ends a token and
which it drops, and where letters, marks and single digits meet, at which it
cuts too; distinct words are tokenized once and kept by a worker.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .tables import hold
from .textscan import Scan, text_batches

SHARD_BYTES = 16 << 20  # text of one shard; a task holds some 20 times that
BLOCK_SYMBOLS = 1 << 18  # of one block; a document is never cut
WORD_PAIRS = 4  # least occurrences of a pair replaced inside words
SEQ_PAIRS = 64  # and between words
WORDS_KEPT = 600_000  # tokenized words kept by a worker, about 120 MB
END_ID = 1
SCHEMA = (
    "shard int, block int, first_id bigint, last_id bigint, doc_ids binary, null_ids binary, symbols_of binary, "
    "tokens_of binary, n_tokens bigint, symbols binary, left binary, right binary, lengths binary"
)
BINS = 1 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


SPACE, LETTER, MARK, DIGIT, OTHER = range(5)
# marks without those that join other pieces (') or begin the tokenizer's special strings (< | >)
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[list(MARKS)] = MARK
_KIND[48:58] = DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each piece, and the bytes with the letters of pieces in lower case.

    Words of Latin letters, marks and digits are cut where the tokenizer cuts
    them: it lower-cases, and takes letters, marks and single digits apart.
    Any other word is one piece, as it is.
    """
    data = scan.data
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, data
    kind = _KIND[data]
    # the letters from U+00C0 to U+00FF, but for the signs of multiplication and division
    two = np.flatnonzero(data[:-1] == 0xC3)
    two = two[~np.isin(data[two + 1], (0x97, 0xB7)) & (data[two + 1] >= 0x80)]
    kind[two] = kind[two + 1] = LETTER
    odd = np.flatnonzero(kind == OTHER)
    if len(odd):
        start, end, _ = scan.words()
        w = np.unique(np.searchsorted(start, odd, "right") - 1)
        n = end[w] - start[w]
        kind[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = OTHER
    low = np.where(kind == LETTER, _LOWER[data], data)
    upper = two[(kind[two] == LETTER) & (data[two + 1] < 0x9F)] + 1
    low[upper] += 32
    before = np.append(np.uint8(SPACE), kind[:-1])
    cut = (kind != before) | (kind == DIGIT)
    start, end = np.flatnonzero(cut & (kind != SPACE)), np.flatnonzero(cut & (before != SPACE))
    return start, end, np.repeat(np.arange(len(scan.ends)), np.diff(np.searchsorted(start, scan.ends), prepend=0)), low


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of their first places, and the number of every value."""
    d = pa.array(values).dictionary_encode()
    return d.dictionary.to_numpy(zero_copy_only=False), d.indices.to_numpy(zero_copy_only=False)


class Words:
    """Token ids of distinct words, kept between shards of a worker as bytes.

    Half of the table is the generation before, so frequent words stay.
    """

    # a word that the tokenizer does not cut: its last token alone bears the mark of a word's end
    whole = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[" + re.escape(MARKS) + b"]+|[0-9]").fullmatch

    def __init__(self, path: str):
        self.tok, self.known, self.before = tokenizer(path), {}, {}
        mark = getattr(self.tok.model, "end_of_word_suffix", None)
        self.last = None
        if mark:
            self.last = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
            self.last[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(mark)]] = True

    def _keep(self, words: list[bytes], ids: np.ndarray, stop: np.ndarray) -> None:
        raw = ids.tobytes()
        stop = (4 * stop).tolist()
        self.known.update(zip(words, [raw[i:j] for i, j in zip([0, *stop[:-1]], stop, strict=True)], strict=True))

    def _encode(self, words: list[bytes]) -> None:
        """Words in one text, parted by spaces: no token crosses these, and marks or offsets tell whose each token is."""
        whole = [self.last is not None and self.whole(w) is not None for w in words]
        for kind in (True, False):
            some = [w for w, x in zip(words, whole, strict=True) if x is kind]
            for lo in range(0, len(some), 500):
                part = some[lo : lo + 500]
                text = b" ".join(part).decode()
                if kind:
                    ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                    stop = np.flatnonzero(self.last[ids]) + 1
                    if len(stop) == len(part) and stop[-1] == len(ids):
                        self._keep(part, ids, stop)
                        continue
                e = self.tok.encode(text, add_special_tokens=False)
                lens = [len(w.decode()) for w in part]
                begin = np.cumsum(np.array(lens, np.int64) + 1) - 1  # the space behind each word
                at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets))
                n = np.bincount(np.searchsorted(begin, at, "right"), minlength=len(part))
                self._keep(part, np.array(e.ids, np.int32), np.cumsum(n))

    def forget(self) -> None:
        self.known, self.before = {}, {}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All (distinct) words' ids in a row, and how many each word has."""
        if len(self.known) > WORDS_KEPT // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        if before:
            known.update([(w, before[w]) for w in new if w in before])
            new = [w for w in new if w not in before]
        self._encode(new)
        raw = [known[w] for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        return np.frombuffer(b"".join(raw), np.int32), sizes


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


class ShardWords:
    """The words of a shard's texts by two hashes, numbered at the end."""

    def __init__(self):
        self.data: list[bytes] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.counts: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        scan = Scan(texts, lower=False)
        start, end, doc, scan.low = pieces(scan)
        self.parts.append((scan.hashes(start, end), scan.hashes(start, end, 1), start + self.size, end + self.size))
        self.counts.append(np.bincount(doc, minlength=len(texts)))
        self.data.append(scan.low.tobytes())
        self.size += len(scan.data)

    def numbered(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, the number of every word in order, and the words of each text."""
        columns = [list(x) for x in zip(*self.parts, strict=True)]
        self.parts = []
        h1, h2, start, end = (np.concatenate(columns.pop(0)) for _ in range(4))
        found, number = distinct(h1)
        first = np.zeros(len(found), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        if (h2 != h2[first][number]).any():
            _, first, number = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True, return_inverse=True)
        del h1, h2, found
        data, self.data = b"".join(self.data), []
        words = [data[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        return words, number.reshape(-1).astype(np.int32), np.concatenate(self.counts)


def replace_pairs(sym: np.ndarray, group: np.ndarray, weight: np.ndarray | None, least: int, rules: list[tuple[int, int]], first: int):
    """Replaces frequent pairs of neighbours of one group until none is left.

    ``weight``: how often each place counts. New symbols are numbered from
    ``first`` by their place in ``rules``. Returns the symbols and groups left.
    """
    # a pair of two older symbols never gets more frequent, so after a round only
    # places of its frequent pairs and of its new symbols are looked at again
    live = np.arange(len(sym) - 1)
    while len(live):
        at = live[group[live] == group[live + 1]]
        code = (sym[at].astype(np.int64) << 32) | sym[at + 1]
        w = None if weight is None else weight[group[at]]
        slot = (code * 0x1E3779B97F4A7C15 >> 20) & (BINS - 1)
        often = np.flatnonzero((np.bincount(slot, w, BINS) >= least)[slot])
        del slot
        if not len(often):
            break
        maybe = at[often]
        pairs, where = distinct(code[often])
        count = np.bincount(where, None if w is None else w[often])
        # all frequent pairs at once; where places overlap the more frequent pair goes first
        chosen = count >= least
        if not chosen.any():
            break
        rank = np.zeros(len(pairs), np.int32)
        rank[chosen] = np.argsort(np.lexsort((pairs[chosen], -count[chosen]))) + 1
        best = int(chosen.sum()) + 1
        prio = np.zeros(len(sym) + 1, np.int32)
        r = rank[where]
        prio[maybe + 1] = np.where(r > 0, best - r, 0)
        # of overlapping places the more frequent pair; in a run of one pair every other place
        start = np.flatnonzero(prio[1:-1] != prio[:-2]) + 1
        stop = np.append(start[1:], len(prio) - 1)
        wins = (prio[start] > 0) & (prio[start] > prio[start - 1]) & (prio[start] > prio[stop])
        start, size = start[wins], (stop - start)[wins]
        half = (size + 1) // 2
        take = np.repeat(start - 1 - 2 * (np.cumsum(half) - half), half) + 2 * np.arange(int(half.sum()))
        used, new = np.unique((sym[take].astype(np.int64) << 32) | sym[take + 1], return_inverse=True)
        sym = sym.copy()
        sym[take] = first + len(rules) + new
        rules += list(zip((used >> 32).tolist(), (used & 0xFFFFFFFF).tolist(), strict=True))
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        again = np.zeros(len(sym), bool)
        again[maybe[r > 0]] = again[take] = again[np.maximum(take - 1, 0)] = True
        sym, group = sym[keep], group[keep]
        live = np.flatnonzero(again[keep][:-1])
    return sym, group


def compress(word_ids: np.ndarray, doc_words: np.ndarray, flat: np.ndarray, sizes: np.ndarray, end_id: int, first: int):
    """Symbols with their document numbers, and the rules, of one shard.

    ``flat`` and ``sizes``: the ids of the distinct words that ``word_ids`` number.
    """
    rules: list[tuple[int, int]] = []
    often = np.bincount(word_ids, minlength=len(sizes)).astype(np.float64)
    flat, owner = replace_pairs(flat, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), often, WORD_PAIRS, rules, first)
    sizes = np.bincount(owner, minlength=len(sizes))
    begin = np.cumsum(sizes) - sizes
    # each word's symbols in its place, then the end id
    n = sizes[word_ids]
    at = np.repeat(begin[word_ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    # a text's symbols are those of its words
    upto = np.append(0, np.cumsum(n))
    last = np.cumsum(doc_words)
    per_doc = upto[last] - upto[last - doc_words]
    sym = np.insert(flat[at], np.cumsum(per_doc), end_id)
    del at, n, upto
    doc = np.repeat(np.arange(len(doc_words), dtype=np.int32), per_doc + 1)
    sym, doc = replace_pairs(sym, doc, None, SEQ_PAIRS, rules, first)
    return sym, doc, rules


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, nulls, shard = ShardWords(), [], [], None
        for b, texts in text_batches(batches, 2):
            shard = b.column(0)[0].as_py()
            ids.append(b.column(1).fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(b.column(1).is_null().to_numpy(zero_copy_only=False))
            found.add(texts)
        if shard is None:
            return
        first = tokenizer(path).get_vocab_size(with_added_tokens=True)
        words, word_ids, counts = found.numbered()
        del found
        table = words_of(path)
        hold("repair", table.forget)
        flat, sizes = table(words)
        del words, table
        sym, doc, rules = compress(word_ids, counts, flat, sizes, end_id, first)
        pairs = np.array(rules, np.int64).reshape(-1, 2)
        lengths = expansion_lengths(pairs, first)
        ids, nulls = np.concatenate(ids), np.concatenate(nulls)
        per_doc = np.bincount(doc, minlength=len(ids))
        size = np.where(sym >= first, lengths[np.maximum(sym - first, 0)] if len(lengths) else 1, 1)
        tokens = np.bincount(doc, size, minlength=len(ids)).astype(np.int64)
        stop = np.cumsum(per_doc)
        block = (stop - per_doc) // BLOCK_SYMBOLS
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in SCHEMA.split(",")]

        def row(**have):
            return pa.RecordBatch.from_arrays([pa.array([have.get(c)], t) for c, t in zip(names, types, strict=True)], names)

        i4 = lambda x: np.ascontiguousarray(x, "<i4").tobytes()
        i8 = lambda x: np.ascontiguousarray(x, "<i8").tobytes()
        yield row(shard=shard, block=-1, left=i4(pairs[:, 0]), right=i4(pairs[:, 1]), lengths=i8(lengths), n_tokens=first)
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(ids)]
        for no, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            real = ids[lo:hi][~nulls[lo:hi]]
            yield row(
                shard=shard, block=no, first_id=int(real[0]) if len(real) else None, last_id=int(real[-1]) if len(real) else None,
                doc_ids=i8(ids[lo:hi]), null_ids=np.packbits(nulls[lo:hi]).tobytes(), symbols_of=i8(per_doc[lo:hi]), tokens_of=i8(tokens[lo:hi]),
                n_tokens=int(tokens[lo:hi].sum()), symbols=i4(sym[stop[lo] - per_doc[lo] : stop[hi - 1]]),
            )

    return run


def write_token_shards(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES
) -> None:
    """Writes the ids of all texts, ``end_id`` behind each, in ascending order of ``id_col``.

    Null texts count as empty: their end id alone. Null ids come first, rows
    with equal ids are ordered by text. An empty table writes no rows.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    ordered = d.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("shard"), "id", "text")
    ordered.mapInArrow(_write(vocabulary, end_id), SCHEMA).write.mode("errorifexists").parquet(path)


class Expander:
    """Token ids of symbols under one shard's rules."""

    def __init__(self, left: bytes, right: bytes, lengths: bytes, first: int):
        a, b, n = np.frombuffer(left, "<i4"), np.frombuffer(right, "<i4"), np.frombuffer(lengths, "<i8")
        self.first, self.size = first, n
        self.start = np.cumsum(n) - n
        flat = np.stack([a, b], 1).astype(np.int64).reshape(-1)
        while (rule := flat >= first).any():
            # every rule among the symbols of all rules becomes its two
            r, k = flat[rule] - first, np.cumsum(1 + rule)[rule] - 2
            flat = np.repeat(flat, 1 + rule)
            flat[k], flat[k + 1] = a[r], b[r]
        self.flat = flat

    def __call__(self, sym: np.ndarray) -> np.ndarray:
        rule = sym >= self.first
        if not rule.any():
            return sym.astype(np.int64)
        r = np.where(rule, sym - self.first, 0)
        n = np.where(rule, self.size[r], 1)
        out = np.repeat(sym.astype(np.int64), n)
        inside = np.repeat(rule, n)
        at = np.repeat(self.start[r] - (np.cumsum(n) - n), n) + np.arange(len(out))
        out[inside] = self.flat[at[inside]]
        return out


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for b in batches:
            for r in b.to_pylist():
                if held[0] != (r["shard"], len(r["left"]), zlib.crc32(r["left"])):
                    held = ((r["shard"], len(r["left"]), zlib.crc32(r["left"])), Expander(r["left"], r["right"], r["lengths"], r["first"]))
                ids = held[1](np.frombuffer(r["symbols"], "<i4")).astype("<u4")
                n = np.frombuffer(r["tokens_of"], "<i8")
                stop = np.cumsum(n)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(stop.tolist(), n.tolist(), strict=True)]
                doc = np.frombuffer(r["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8), count=len(doc)).astype(bool)
                cols = [pa.array(doc, mask=null), pa.array(r["start"] + stop - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_token_shards(spark: SparkSession, path: str, with_ids: bool = False, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    ``start`` counts the ids of all documents before. With a range of ids only
    the blocks that hold it are expanded; blocks come whole.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    # lengths alone are read for the starts
    sizes = files.filter("block >= 0").select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.join(shards.select("shard", before.alias("before")), "shard").select("shard", "block", (F.col("before") + inside).alias("start"))
    blocks = files.filter("block >= 0")
    if first_id is not None:
        blocks = blocks.filter(F.col("last_id") >= first_id)
    if last_id is not None:
        blocks = blocks.filter(F.col("first_id") <= last_id)
    rules = files.filter("block = -1").select("shard", "left", "right", "lengths", F.col("n_tokens").alias("first"))
    rows = blocks.select("shard", "block", "doc_ids", "null_ids", "tokens_of", "symbols").join(starts, ["shard", "block"]).join(rules, "shard")
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_read(with_ids), ddl)
