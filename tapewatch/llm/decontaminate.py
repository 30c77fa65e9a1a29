"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages (windows of words). TF-IDF vectors of the
passages over the words of the benchmark form a tall sparse matrix. A
randomised decomposition of it needs one pass: every task multiplies its rows
with a random matrix and back, the partial products are added, and the small
sum gives the leading right singular vectors. Passages of documents and of
benchmark items are compared by cosine in that space, scaled so that each
direction counts alike. Each pair above the threshold is then checked on the
words themselves: the longest common subsequence of the item and the passage's
surroundings, and whether the item's answer (its end) is there.

The benchmark is worked through in blocks of bounded size, each against all
documents; nothing of the documents is sent anywhere but the pairs found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import lean, staged
from .textscan import U64, Scan, ids_of, text_batches

HOP = 16  # words; a passage is two hops, an item's part one
SHORT_HOP = 4  # for items of fewer than HOP words, which a longer passage would drown
PARTS_ROWS = 256  # words of the vocabulary in one partial product
RANK, EXTRA = 96, 16
BLOCK_BYTES = 256 << 10  # benchmark text worked on at once: at most 16 MB of products
COSINE = 0.45
WHOLE, PART = 0.8, 0.55  # share of the item in order: enough alone, enough with the answer
ANSWER = 0.6  # share of the answer's words
SEED = 5
PIECE = 4096  # passages whose vectors are held at once
PAIRS = 1 << 18  # near pairs looked at at once
LONG = 64  # groups of more rows are added by one product each
SLOT_BITS = 18


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    scan = Scan(texts)
    start, end, doc = scan.words()
    return scan.hashes(start, end), doc


@dataclass
class Items:
    """A block of benchmark items: ids, their words' hashes, where the answer begins, and the vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    answer: list[int]
    vocab: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        raw = [(t or "").encode() for _, t in rows]
        h, doc = word_hashes(raw)
        words = [h[doc == i] for i in range(len(raw))]
        keep = [i for i, w in enumerate(words) if len(w)]
        answer = []
        for i in keep:
            # the answer is the last sentence of three words or more, else the last quarter
            n, tail = len(words[i]), 0
            sentences = [s for s in (rows[i][1] or "").replace("\n", ". ").split(". ") if s.strip()]
            for s in reversed(sentences):
                tail += len(s.encode().split())
                if tail >= 3:
                    break
            answer.append(n - tail if 3 <= tail <= n // 2 else n - max(1, n // 4))
        return Items([rows[i][0] for i in keep], [words[i] for i in keep], answer, np.unique(h))

    def scales(self) -> list[int]:
        """Hops at which items are sought: each item at the one that suits its length."""
        return sorted({self.hop_of(w) for w in self.words}, reverse=True)

    @staticmethod
    def hop_of(words: np.ndarray) -> int:
        return HOP if len(words) >= HOP else SHORT_HOP

    def parts(self, hop: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Parts of a hop each (the last one overlaps) of the items sought at this hop: item, and words as numbers."""
        owner, lists = [], []
        for q, w in enumerate(self.words):
            if self.hop_of(w) != hop:
                continue
            for lo in [*range(0, len(w) - hop, hop), max(0, len(w) - hop)]:
                owner.append(q)
                lists.append(np.searchsorted(self.vocab, w[lo : lo + hop]))
        return np.array(owner), lists


def hops(doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each run of ``size`` words of one text, and its text."""
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    at = np.flatnonzero(place % size == 0)
    return at, doc[at]


class Vocabulary:
    """Sorted hashes of words. The first bits of a hash tell most other words apart without a search."""

    def __init__(self, vocab: np.ndarray):
        self.vocab = vocab
        self.shift = U64(64 - SLOT_BITS)
        self.taken = np.zeros(1 << SLOT_BITS, bool)
        self.taken[vocab >> self.shift] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words of the vocabulary, and their numbers."""
        maybe = np.flatnonzero(self.taken[h >> self.shift])
        h = h[maybe]
        i = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        hit = self.vocab[i] == h
        return maybe[hit], i[hit]


def row_sums(table: np.ndarray, index: np.ndarray, begin: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sum of the (weighted) rows of ``table`` that each group names; group i is ``index[begin[i] : begin[i + 1]]``.

    Longest groups first, so the j-th rows of all groups that have one are
    added to a run of sums at once.
    """
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    first, size = begin[:-1][order], size[order]
    out = np.zeros((len(size), table.shape[1]), table.dtype)
    few = int(np.searchsorted(-size, -LONG))
    for g in range(few):
        part = slice(first[g], first[g] + size[g])
        out[g] = table[index[part]].sum(0) if weight is None else weight[part] @ table[index[part]]
    first, size, short = first[few:], size[few:], out[few:]
    for j in range(int(size[0]) if len(size) else 0):
        at = first[: np.searchsorted(-size, -j)] + j
        rows = table[index[at]]
        if weight is not None:
            rows *= weight[at, None]
        short[: len(at)] += rows
    back = np.empty_like(out)
    back[order] = out
    return back


def _entries(texts: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passages of two hops, without overlap, as (passage, word, count), and their number."""
    h, doc = word_hashes(texts)
    at, _ = hops(doc, 2 * HOP)
    place, word = vocab(h)
    n = len(vocab.vocab)
    code = (np.searchsorted(at, place, "right") - 1) * n + word
    code, count = np.unique(code, return_counts=True)
    return code // n, code % n, count, len(at)


def _frequencies(vocab: np.ndarray):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, known = np.zeros(len(vocab), np.int64), 0, Vocabulary(vocab)
        for _, texts in text_batches(batches, 0):
            _, word, _, passages = _entries(texts, known)
            total += np.bincount(word, minlength=len(vocab))
            n += passages
        word = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.append(total[word[:-1]], n))], ["word", "n"])

    return run


def _product(vocab: np.ndarray, idf: np.ndarray, columns: int):
    """This part's share of (transposed matrix) x (matrix) x (random matrix), by rows of the vocabulary."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(SEED).standard_normal((len(vocab), columns)).astype(np.float32)
        out, known = np.zeros((len(vocab), columns)), Vocabulary(vocab)
        for _, texts in text_batches(batches, 0):
            row, word, count, _ = _entries(texts, known)
            if not len(row):
                continue
            row = np.unique(row, return_inverse=True)[1]
            value = (count * idf[word]).astype(np.float32)
            norm = np.sqrt(np.bincount(row, value * value))
            value /= np.maximum(norm, 1e-9)[row].astype(np.float32)
            first = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
            for lo in range(0, len(first) - 1, PIECE):
                # some thousand passages at a time keep the gathered rows in memory
                begin = first[lo : lo + PIECE + 1]
                a, b = begin[0], begin[-1]
                w, v = word[a:b], value[a:b]
                p = row_sums(random, w, begin - a, v)
                order = np.argsort(w, kind="stable")
                ws = w[order]
                cut = np.flatnonzero(np.diff(ws, prepend=-1))
                out[ws[cut]] += row_sums(p, (row[a:b] - row[a])[order], np.append(cut, len(ws)), v[order])
        blocks = range(0, len(vocab), PARTS_ROWS)
        raw = [out[lo : lo + PARTS_ROWS].tobytes() for lo in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int32()), pa.array(raw, pa.binary())], ["block", "sums"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "sums": [total.tobytes()]})


def latent_space(texts: DataFrame, items: Items) -> np.ndarray:
    """A row of coordinates for each word of the vocabulary, idf included."""
    vocab = items.vocab
    counts = texts.mapInArrow(_frequencies(vocab), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, passages = np.zeros(len(vocab)), 0
    for r in counts:
        if r.word < 0:
            passages = r.n
        else:
            df[r.word] = r.n
    idf = np.log((passages + 1) / (df + 1)) + 0.05
    columns = min(RANK + EXTRA, len(vocab))
    parts = texts.mapInArrow(_product(vocab, idf, columns), "block int, sums binary").withColumn("part", F.spark_partition_id() % 256)
    sums = parts.groupBy("block", "part").applyInPandas(_add, "block int, sums binary").groupBy("block").applyInPandas(_add, "block int, sums binary")
    y = np.zeros((len(vocab), columns))
    for r in sums.collect():
        rows = np.frombuffer(r.sums).reshape(-1, columns)
        y[r.block * PARTS_ROWS : r.block * PARTS_ROWS + len(rows)] = rows
    # the items are passages too, so the space holds words the documents lack
    omega = np.random.default_rng(SEED).standard_normal((len(vocab), columns))
    for words in [w for hop in items.scales() for w in items.parts(hop)[1]]:
        w, c = np.unique(words, return_counts=True)
        v = c * idf[w] / np.linalg.norm(c * idf[w])
        y[w] += np.outer(v, v @ omega[w])
    # eigenvectors of the Gram matrix from its product with a random matrix
    q, _ = np.linalg.qr(y)
    core = np.linalg.lstsq(omega.T @ q, y.T @ q, rcond=None)[0]
    value, vec = np.linalg.eigh((core + core.T) / 2)
    order = np.argsort(-value)[:RANK]
    order = order[value[order] > 1e-9 * max(value.max(), 1e-300)]
    scale = np.sqrt(np.maximum(value[order], 1e-12))
    return ((q @ vec[:, order]) / scale * idf[:, None]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit of a number for each word of ``a``."""
    at: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a.tolist()):
        at[x] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = at.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def verified(item: np.ndarray, answer: int, words: np.ndarray) -> tuple[int, int] | None:
    """Common subsequence and answer words found, if they amount to the item."""
    n = len(item)
    lcs = common_subsequence(item, words)
    end = item[answer:]
    found = common_subsequence(end, words)
    if lcs >= WHOLE * n or (lcs >= PART * n and found >= ANSWER * len(end)):
        return lcs, found
    return None


def _directions(of: np.ndarray, begin: np.ndarray, word: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Directions of the passages that begin at each hop (two hops of one text), some thousand at a time.

    ``of``: the texts of the hops; ``begin``: where the words of each begin in ``word``.
    """
    for lo in range(0, len(of), PIECE):
        hi = min(lo + PIECE, len(of))
        more = min(hi + 1, len(of))  # the hop behind the last passage
        vec = row_sums(space, word, begin[lo : more + 1])
        vec[:-1] += vec[1:] * (of[lo + 1 : more] == of[lo : more - 1])[:, None]
        vec = vec[: hi - lo]
        vec /= np.maximum(np.linalg.norm(vec, axis=1), 1e-9)[:, None]
        yield lo, vec


def _candidates(of: np.ndarray, begin: np.ndarray, word: np.ndarray, space: np.ndarray, target: np.ndarray):
    """Passages and item parts that are near, as hops, parts and cosines; about ``PAIRS`` at a time."""
    held, n = [], 0
    for lo, vec in _directions(of, begin, word, space):
        cos = (vec @ target).ravel()
        near = np.flatnonzero(cos >= COSINE)
        for k in range(0, len(near), PAIRS):
            some = near[k : k + PAIRS]
            held.append((some // target.shape[1] + lo, some % target.shape[1], cos[some]))
            n += len(some)
            if n >= PAIRS:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _in_common(hit: np.ndarray, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many words of ``word[lo:hi]`` are hit, for each pair of bounds; what is gathered is never more than all between them."""
    first, n = int(lo.min()), hi - lo
    upto = np.cumsum(n)
    if upto[-1] < int(hi.max()) - first:
        got, lo, hi = hit[word[np.repeat(lo - (upto - n), n) + np.arange(upto[-1])]], upto - n, upto
    else:
        got, lo, hi = hit[word[first : int(hi.max())]], lo - first, hi - first
    total = np.append(0, np.cumsum(got))
    return total[hi] - total[lo]


def _search(items: Items, space: np.ndarray):
    numbers = [np.searchsorted(items.vocab, w) for w in items.words]
    kinds = [np.unique(w) for w in numbers]
    length = np.array([len(w) for w in items.words])
    targets = []
    for hop in items.scales():
        owner, lists = items.parts(hop)
        t = np.stack([space[w].sum(0) for w in lists])
        targets.append((hop, owner, (t / np.maximum(np.linalg.norm(t, axis=1), 1e-9)[:, None]).T.astype(np.float32)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = np.zeros(len(items.vocab), bool), Vocabulary(items.vocab)
        for b, texts in text_batches(batches):
            h, doc = word_hashes(texts)
            best: dict[tuple[int, int], tuple] = {}
            place, word = known(h)
            text_start = np.searchsorted(doc, np.arange(len(texts)))
            text_end = np.searchsorted(doc, np.arange(len(texts)), "right")
            for hop, owner, target in targets if len(place) else []:
                at, of = hops(doc, hop)
                begin = np.append(np.searchsorted(place, at), len(place))
                for i, j, cos in _candidates(of, begin, word, space, target):
                    order = np.argsort(owner[j], kind="stable")
                    i, q, cos = i[order], owner[j][order], cos[order]
                    n = length[q]
                    a, e = np.maximum(text_start[of[i]], at[i] - n), np.minimum(text_end[of[i]], at[i] + 2 * hop + n)
                    lo, hi = np.searchsorted(place, a), np.searchsorted(place, e)
                    # no common subsequence is longer than the words either side has in common
                    mine = np.zeros(len(q), np.int64)
                    edges = np.append(np.flatnonzero(np.diff(q, prepend=-1)), len(q))
                    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        here[kinds[q[x]]] = True
                        mine[x:y] = _in_common(here, word, lo[x:y], hi[x:y])
                        here[kinds[q[x]]] = False
                    for c in np.flatnonzero(mine >= PART * n).tolist():
                        k, t, near = int(q[c]), int(of[i[c]]), word[lo[c] : hi[c]]
                        here[near] = True
                        enough = here[numbers[k]].sum() >= PART * n[c]
                        here[near] = False
                        if not enough:
                            continue
                        got = verified(items.words[k], items.answer[k], h[a[c] : e[c]])
                        if got:
                            have = best.get((t, k))
                            new = (got[0], float(cos[c]), got[1])
                            if have is None or new > have:
                                best[t, k] = new
            ids, null = ids_of(b)
            keys = list(best)
            cols = [
                pa.array([int(ids[t]) for t, _ in keys], pa.int64(), mask=np.array([null[t] for t, _ in keys], bool)),
                pa.array([items.ids[q] for _, q in keys], pa.int64()),
                pa.array([v[1] for v in best.values()], pa.float64()),
                pa.array([v[0] for v in best.values()], pa.int64()),
                pa.array([len(items.words[q]) for _, q in keys], pa.int64()),
                pa.array([v[2] for v in best.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "cosine", "lcs", "item_words", "answer_words"])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, one row for each.

    Columns: doc_id, item_id, cosine (of the best passage), lcs (words of the
    item found in order), item_words, answer_words. Words are lower-cased A-Z
    between white space. Null or empty texts and items hold nothing and are
    held by nothing; a document with null id gives rows with null id, rows
    that repeat an id are each searched. Ties go to the higher cosine.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).filter("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    ddl = "doc_id bigint, item_id bigint, cosine double, lcs bigint, item_words bigint, answer_words bigint"
    found = None
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        items = Items.of([(r.item, r.text) for r in part])
        if not items.ids:
            continue
        space = latent_space(texts.select("text"), items)
        hits = texts.mapInArrow(_search(items, space), ddl)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], ddl)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (a null id is kept)."""
    bad = staged(contaminated(docs, benchmark, id_col, **names).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(bad, id_col, "left_anti")
