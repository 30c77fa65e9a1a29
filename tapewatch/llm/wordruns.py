"""Periodic runs of words by the grouping phase of Baier's suffix sorter.

A run is a maximal stretch of words with smallest period q. By the runs
theorem each run holds, under one of the two orders of the words (any order
and its reverse), a Lyndon word of length q that is the longest Lyndon word
beginning at its place, at every repetition inside the run. So

1. **Grouping.** Phase one of the suffix sorter groups the suffixes by the
   longest Lyndon word they begin with. Groups are taken from the greatest to
   the smallest; a suffix of the current group hands its word to the nearest
   suffix on its left that is in a lower group, which moves to a new group
   right above its own. A suffix leaves the order with its group's length: its
   entry of the Lyndon array. No suffix array is made. Once for the order of
   the words and once for its reverse.
2. **Roots.** Places i, i + q, i + 2 q of one final group of length q are
   three copies of one Lyndon root side by side; a run of exponent 4 has them.
3. **Extension.** The longest common extensions of the first copy and the one
   behind it, to both sides, give the whole run.

Words that no such run can hold are set aside first: every three words of a
run with exponent 4 (and at least six words) occur in it three times, so only
stretches made of triples that their text holds three times are grouped.
Stretches of many texts form one sequence with a separator of its own behind
each, which no run crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textscan import U64, Scan, mix, text_batches

EXPONENT = 4
LEAST = 6  # words
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_groups(x: list[int]) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon word at each place of ``x``, and its group (equal numbers: equal words).

    ``x`` holds numbers from 0. The work is linear, but for the search of the
    nearest lower suffix, which shortens its paths as it goes.
    """
    n, kinds = len(x), max(x, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, g in enumerate(x):
        members[g].append(i)
    group, size = list(x), [1] * kinds
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))  # the groups' order as a linked list
    lyndon, final = [0] * n, [0] * n
    left = list(range(n + 1))  # itself while suffix i - 1 waits, else a place to its left; place 0 stops every search
    g = kinds - 1
    while g >= 0:
        mine, length = [i for i in members[g] if group[i] == g], size[g]
        for i in mine:
            lyndon[i], final[i], left[i + 1] = length, g, i
        takes: dict[int, int] = {}
        for i in mine:
            p = i
            while left[p] != p:
                left[p] = p = left[left[p]]
            if p:
                takes[p - 1] = takes.get(p - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, copies in takes.items():
            moves.setdefault((group[j], copies), []).append(j)
        # more copies of the current word make a greater group, so they are put above first
        for old, copies in sorted(moves, reverse=True):
            new, up = len(members), above[old]
            members.append(moves[old, copies])
            size.append(size[old] + copies * length)
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
            for j in members[new]:
                group[j] = new
        g = below[g]
    return lyndon, final


def extension(x: np.ndarray, i: int, j: int, step: int) -> int:
    """Number of equal places of ``x`` from i and j (i < j) on, in direction ``step``."""
    most = len(x) - j if step > 0 else i + 1
    done, width = 0, 64
    while done < most:
        w = min(width, most - done)
        if step > 0:
            same = x[i + done : i + done + w] == x[j + done : j + done + w]
        else:
            same = x[i - done - w + 1 : i - done + 1][::-1] == x[j - done - w + 1 : j - done + 1][::-1]
        if not same.all():
            return done + int(same.argmin())
        done, width = done + w, width * 2
    return most


def runs_of(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``x`` with length >= max(6, 4 * period), by start and period."""
    arr, found = np.asarray(x, np.int64), set()
    top = max(x, default=0)
    for seq in (x, [top - v for v in x]):
        lyndon, final = (np.asarray(v, np.int64) for v in lyndon_groups(seq))
        place = np.arange(len(arr))
        second, third = place + lyndon, place + 2 * lyndon
        root = third < len(arr)
        root[root] = (final[second[root]] == final[root]) & (final[third[root]] == final[root])
        before = place - lyndon
        root &= (before < 0) | (final[np.maximum(before, 0)] != final)
        for i in np.flatnonzero(root).tolist():
            q = int(lyndon[i])
            back = extension(arr, i - 1, i + q - 1, -1) if i else 0
            length = back + q + extension(arr, i, i + q, 1)
            if length >= max(LEAST, EXPONENT * q):
                found.add((i - back, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and number of words of each stretch of words that a run may hold."""
    start, end, doc = scan.words()
    none = np.zeros(0, np.int64)
    m = len(start) - 2
    if m <= 0:
        return none, none, none
    h = scan.hashes(start, end)
    with np.errstate(over="ignore"):
        triple = h[:m] * U64(0xD6E8FEB86659FD93) + h[1 : m + 1] * U64(0xA0761D6478BD642F) + h[2:]
        key = mix(triple ^ mix(doc[:m].astype(U64)))
    # a triple over the border of two texts is of neither
    at = np.flatnonzero(doc[:m] == doc[2:])
    order = np.argsort(key[at], kind="stable")
    at, ranked = at[order], key[at][order]
    first = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]) != 0)
    often = np.repeat(np.diff(np.append(first, len(ranked))) >= 3, np.diff(np.append(first, len(ranked))))
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, at[often], 1)
    np.add.at(cover, at[often] + 3, -1)
    held = np.cumsum(cover[:-1]) > 0
    # stretches end at words not held and at the ends of texts
    begin = held & np.append(True, ~held[:-1] | (doc[1:] != doc[:-1]))
    stop = held & np.append(~held[1:] | (doc[1:] != doc[:-1]), True)
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= LEAST
    base = np.searchsorted(doc, doc[a[long]])
    return doc[a[long]], a[long] - base, (b - a)[long]


def _batch_runs(texts: list[bytes], words: dict[int, list[bytes]]) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each text that has any; leaves the words of texts looked at in ``words``."""
    text, begin, size = _stretches(Scan(texts, lower=False))
    rank: dict[bytes, int] = {}
    seq: list[int] = []
    origin: list[tuple[int, int]] = []  # text and word number of each stretch, by its place in the sequence
    places: list[int] = []
    for t, b, n in zip(text.tolist(), begin.tolist(), size.tolist(), strict=True):
        if t not in words:
            words[t] = texts[t].split()
        places.append(len(seq))
        origin.append((t, b))
        seq += [rank.setdefault(w, len(rank)) for w in words[t][b : b + n]]
        seq.append(-len(places))
    kinds = len(rank)
    found: dict[int, list[tuple[int, int, int]]] = {}
    # separators get numbers of their own, above all words
    for s, n, q in runs_of([v if v >= 0 else kinds - 1 - v for v in seq]):
        k = int(np.searchsorted(places, s, "right")) - 1
        t, b = origin[k]
        found.setdefault(t, []).append((b + s - places[k], n, q))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words but for those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _scan(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b, texts in text_batches(batches, names.index("__text")):
        words: dict[int, list[bytes]] = {}
        found = _batch_runs(texts, words)
        n_words, rows, kept = [], [], []
        for i, text in enumerate(texts):
            own = words.get(i) or text.split()
            got = found.get(i, [])
            n_words.append(len(own))
            rows.append([{"start": s, "length": n, "period": q} for s, n, q in got])
            kept.append(b" ".join(collapse(own, got) if got else own))
        new = [pa.array(n_words, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.binary()).cast(pa.string())]
        old = [i for i, n in enumerate(names) if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in old), *new], [*(names[i] for i in old), "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the runs of words of each text, and the text with every run cut to its first period.

    New columns (columns of these names are replaced): ``n_words``; ``runs``,
    all runs with length >= max(6, 4 * period) by start and period, words
    numbered from 0; ``collapsed``, the kept words joined by one space. A word
    is a run of other characters than space and U+0009 to U+000D. A word goes
    if any run holds it after that run's first ``period`` words.

    A null text or one without words has no words, no runs and an empty
    ``collapsed``. Rows are independent of each other: repeated rows and null
    ids give what their text gives. Nothing is shuffled; a task holds about
    1 MB of texts at once, or one longer text.
    """
    new = ("n_words", "runs", "collapsed")
    rest = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in new), F.col(text_col).alias("__text"))
    names = rest.columns
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields if f.name != "__text"]
    schema = ", ".join([*ddl, "n_words bigint", f"runs {RUNS}", "collapsed string"])
    return rest.mapInArrow(lambda batches: _scan(batches, names), schema)


def with_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail planted in about a tenth of the texts, chosen by a checksum of the id.

    With h = crc32(decimal id), g = floor(h / 10) and n words numbered from 0:
    where h % 10 = 0 and n > 0, each word i >= a = g % n becomes word
    a + (i - a) % p of the text, p = 1 + floor((n - a) / (3 + g % 8)). Other
    texts, and those of rows with null id, stay as they are.
    """
    h, text = F.crc32(F.col(id_col).cast("string")), F.col(text_col)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    out = docs.withColumn(text_col, F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), _planted(words, (h / 10).cast("bigint"))).otherwise(text))
    return out


def _planted(words: F.Column, g: F.Column) -> F.Column:
    # one-element arrays name the parts, so that words are cut once
    def made(p):
        w, g = p["w"], p["g"]
        n = F.size(w)
        a = g % n
        period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = F.transform(F.sequence(a, n.cast("bigint") - 1), lambda i: F.get(w, (a + (i - a) % period).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    return F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), made)[0]
