"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone.
An n-gram's vector binds its letters' vectors, each permuted (rotated) by its
place in the n-gram; a text's vector bundles (adds) the vectors of all its
n-grams, and a language's prototype those of all its learning texts. A text
gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import hold, lean, with_columns
from .textscan import BATCH_BYTES

DIM = 1024
N = 3
SEED = 71
UNKNOWN = "und"
COLUMNS = 4096  # n-grams multiplied at once
ROWS = 512  # texts multiplied at once
DENSE = 1 << 22  # largest table of n-gram numbers kept as a flat array
_place = np.full(0x110000, -1, np.int32)  # letter number of a code point, 0: no letter, -1: not met
_letters: list[int] = [32]


@lru_cache(maxsize=4096)
def letter_vector(code_point: int) -> np.ndarray:
    return np.random.default_rng([SEED, code_point]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as rows of code points."""
    out = np.ones((len(grams), DIM), np.int8)
    for j in range(grams.shape[1]):
        points, at = np.unique(grams[:, j], return_inverse=True)
        turned = np.stack([np.roll(letter_vector(int(p)), grams.shape[1] - 1 - j) for p in points])
        out *= turned[at]
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram number) of every n-gram of every text, and the n-grams as code points.

    Letters are lower-cased; anything else is a word border, written as a
    space. N-grams do not cross borders but may begin or end with one.
    """
    low = [f" {t.lower()} " for t in texts]
    x = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    for p in np.unique(x[_place[x] < 0]).tolist():
        letter = chr(p).isalpha()
        _place[p] = len(_letters) if letter else 0
        if letter:
            _letters.append(p)
    s = _place[x].astype(np.int64)
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    keep[:-1] |= s[1:] > 0
    s, doc = s[keep], doc[keep]
    m = len(s) - N + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N), np.int64)
    ok = doc[:m] == doc[N - 1 :]
    base, code = len(_letters), np.zeros(m, np.int64)
    for j in range(N):
        code = code * base + s[j : j + m]
        if 0 < j < N - 1:
            ok &= s[j : j + m] > 0
    code, doc = code[ok], doc[:m][ok]
    if base**N <= DENSE:
        there = np.flatnonzero(np.bincount(code, minlength=base**N))
        number = np.zeros(base**N, np.int64)
        number[there] = np.arange(len(there))
        at = number[code]
    else:
        there, at = np.unique(code, return_inverse=True)
    points = np.array(_letters)
    grams = np.stack([points[there // base ** (N - 1 - j) % base] for j in range(N)], 1) if len(there) else np.zeros((0, N), np.int64)
    return doc, at, grams


def text_vectors(texts: list[str]) -> np.ndarray:
    doc, at, grams = gram_counts(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    for lo in range(0, len(grams), COLUMNS):
        part = grams[lo : lo + COLUMNS]
        sel = slice(None) if len(grams) <= COLUMNS else (at >= lo) & (at < lo + len(part))
        counts = np.bincount(doc[sel] * len(part) + at[sel] - lo, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ gram_vectors(part).astype(np.float32)
    return out


def _pieces(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    lo = size = 0
    for i, x in enumerate(b.column(at)):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size > BATCH_BYTES or i + 1 - lo >= ROWS:
            yield b.slice(lo, i + 1 - lo)
            lo, size = i + 1, 0
    if lo < b.num_rows:
        yield b.slice(lo)


@lean
def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bundled vector for each language in this part: rows (lang, text)."""
    hold("langid", letter_vector.cache_clear)
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for b in _pieces(whole, 1):
            lang = b.column(0).to_pylist()
            names = sorted(set(lang))
            doc, at, grams = gram_counts([x or "" for x in b.column(1).to_pylist()])
            own = np.array([names.index(x) for x in lang])[doc] if len(doc) else doc
            for lo in range(0, len(grams), COLUMNS):
                part = grams[lo : lo + COLUMNS]
                sel = (at >= lo) & (at < lo + len(part))
                c = np.bincount(own[sel] * len(part) + at[sel] - lo, minlength=len(names) * len(part)).reshape(len(names), -1)
                v = c.astype(np.float64) @ gram_vectors(part).astype(np.float64)
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + v[i]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vec"])


def _bundle(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v) for v in pdf["vec"]], axis=0)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "vec": [total.tobytes()]})


@dataclass
class Profiles:
    """Languages in ascending order and their prototypes (unit rows, 8 KB each)."""

    langs: list[str]
    matrix: np.ndarray


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Prototypes from all rows with a language.

    Every row counts by its n-grams. Tasks send one vector a language; these
    are added in two steps, so that no task adds those of all others.
    """
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(_learn, "lang string, vec binary").withColumn("part", F.spark_partition_id() % 256)
    some = parts.groupBy("lang", "part").applyInPandas(_bundle, "lang string, vec binary")
    found = some.groupBy("lang").applyInPandas(_bundle, "lang string, vec binary").orderBy("lang").collect()
    m = np.array([np.frombuffer(r.vec) for r in found]).reshape(-1, DIM)
    norm = np.linalg.norm(m, axis=1)
    return Profiles([r.lang for r, n in zip(found, norm, strict=True) if n], (m[norm > 0] / norm[norm > 0, None]).astype(np.float32))


def _predict(at: int, profiles: Profiles):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid", letter_vector.cache_clear)
        for whole in batches:
            for b in _pieces(whole, at):
                vec = text_vectors([x or "" for x in b.column(at).to_pylist()])
                norm = np.linalg.norm(vec, axis=1)
                if len(profiles.langs):
                    cos = vec @ profiles.matrix.T / np.maximum(norm, 1e-9)[:, None]
                    best = cos.argmax(1)
                    score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(np.float64)
                else:
                    best, score = np.zeros(len(vec), int), np.zeros(len(vec))
                known = (norm > 0) & (len(profiles.langs) > 0)
                lang = [profiles.langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                cols = {c: b.column(i) for i, c in enumerate(b.schema.names) if c not in ("lang_pred", "score")}
                cols |= {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.where(known, score, 0.0))}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def predict_languages(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (cosine, 0 to 1).

    The whole text is used and nothing else. A text that is null or has no
    letter gets ``und`` and score 0, as all do when no language was learned.
    Equal cosines go to the first language in ascending order. Columns of
    ``docs`` with these names are replaced.
    """
    return docs.mapInArrow(_predict(docs.columns.index(text_col), profiles), with_columns(docs, "lang_pred string, score double"))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Rows kept from learning: crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
