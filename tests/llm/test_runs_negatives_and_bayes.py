"""Operators 11 to 13 against brute force, and on edge rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tapewatch.llm import bayesdedup, hardnegatives as hn, wordruns
from tapewatch.llm.bayesdedup import near_duplicates
from tapewatch.llm.hardnegatives import hard_negatives
from tapewatch.llm.ngramjoin import jaccard_components
from tapewatch.llm.wordruns import lyndon_groups, periodic_runs, runs_of, with_repetition

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lyndon_by_definition(x):
    return [max(j - i for j in range(i + 1, len(x) + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))) for i in range(len(x))]


def runs_by_definition(x):
    n, found = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted([(s, n, q) for (s, n), q in found.items()], key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 2), max_size=24))
@settings(max_examples=150, deadline=None)
def test_lyndon_groups(x):
    length, group = lyndon_groups(x)
    assert length == lyndon_by_definition(x)
    words = [tuple(x[i : i + n]) for i, n in enumerate(length)]
    assert len(set(words)) == len(set(group)) == len(set(zip(words, group, strict=True)))


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=4), st.integers(1, 7)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_runs_equal_the_definition(parts):
    x = [v for word, n in parts for v in word * n]
    assert runs_of(x) == runs_by_definition(x)


def planted_by_definition(doc_id, text):
    words = text.encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_periodic_runs_of_documents(spark, docs):
    rows = {r.doc_id: r for r in periodic_runs(with_repetition(docs.select("doc_id", "text"))).collect()}
    assert len(rows) == docs.count()
    some = 0
    for d in docs.collect():
        words, got = planted_by_definition(d.doc_id, d.text or ""), rows[d.doc_id]
        want = runs_by_definition(words)
        assert [tuple(r) for r in got.runs] == want and got.n_words == len(words)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert got.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
        some += bool(want)
    assert some >= 10


def test_periodic_runs_digest_columns(spark, root):
    from tapewatch.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, root).collect()}
    for d in spark.read.parquet(f"{root}/documents.parquet").collect():
        want, r = runs_by_definition(planted_by_definition(d.doc_id, d.text or "")), got[d.doc_id]
        best = min(want, key=lambda v: (-v[1] / v[2], v[0], v[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()


def test_periodic_runs_edges(spark, edge, nothing):
    many = spark.createDataFrame([(20, "x " * 5000, "c", None, 1), (None, "a b " * 9, None, None, None)], SCHEMA)
    plain = edge.withColumns({"runs": F.lit("clash"), "Collapsed": F.lit("clash"), "n_words": F.lit("clash")})
    rows = periodic_runs(plain).collect()
    assert len(rows) == edge.count()
    by_text = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_text[3].n_words == by_text[4].n_words == by_text[5].n_words == 0 and by_text[3].collapsed == "" and by_text[3].runs == []
    assert by_text[10].collapsed == "A B" and by_text[9].lang == "en"
    got = {r.doc_id: r for r in periodic_runs(many).collect()}
    assert [tuple(r) for r in got[20].runs] == [(0, 5000, 1)] and got[20].collapsed == "x"
    assert [tuple(r) for r in got[None].runs] == [(0, 18, 2)] and got[None].collapsed == "a b"
    assert periodic_runs(nothing).count() == with_repetition(nothing).count() == 0


def test_extension_stops_at_the_ends():
    x = np.array([1, 2] * 300)
    assert wordruns.extension(x, 0, 2, 1) == 598 and wordruns.extension(x, 597, 599, -1) == 598
    assert wordruns.extension(np.array([1, 2, 3]), 0, 1, 1) == 0


# --- hard negatives -------------------------------------------------------


def negatives_by_definition(rows, anchors, scale=256):
    ints = lambda v: [int(np.floor(scale * float(x))) for x in v]
    kept = lambda i, v, l: i is not None and v and l is not None and all(x is not None and np.isfinite(x) for x in v)
    rows = sorted({(i, l, tuple(ints(v))) for i, v, l in rows if kept(i, v, l)})
    out = []
    for a, label, v in sorted({(i, l, tuple(ints(v))) for i, v, l in anchors if kept(i, v, l)}):
        near = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, l) for i, l, w in rows if i != a and len(w) == len(v)]
        near.sort()
        for ps, p, _ in [n for n in near if n[2] == label][:5]:
            ok = [n for n in near if n[2] != label and 80 * -ps <= 100 * -n[0] <= 100 * -ps][:5]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(ok)]
    return sorted(out)


def random_vectors(seed, n, dim=6):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [rnd.choice(middle)[j] + rnd.gauss(0, 0.3) for j in range(dim)], rnd.randrange(3)) for i in range(n)]
    copies = [(n + i, rows[0][1], rnd.randrange(3)) for i in range(40)]
    odd = [(500, None, 1), (501, [1.0, None] + [0.0] * 4, 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] * 6, 1), (504, [], 1), (505, [0.0] * 6, None)]
    odd += [(506, [0.0] * 6, 1), (600, [0.0] * 6, 2), (None, [1.0] * 6, 1), (507, [1.0, 2.0], 1), (507, [1.0, 2.5], 2), (700, [2.0, 2.0], 1), (508, [2.0, 1.0], 1)]
    return rows + copies + odd + rows[:5]


@pytest.mark.parametrize("seed, shard, part", [(1, 37, 2), (2, 1000, 1000)])
def test_hard_negatives_equal_all_products(spark, seed, shard, part):
    rows = random_vectors(seed, 420)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"key": F.lit("clash"), "part": F.lit(1)})
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = hard_negatives(df, df.filter("vec_id % 20 = 0"), shard_rows=shard, part_rows=part)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == negatives_by_definition(rows, asked)


def test_hard_negatives_of_nothing_and_of_huge_components(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives(none, none).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (2, [2.0e6, 1.0], 1), (3, [1.9e6, 1.0], 2), (100, [1.0e6, 1.0], 1)], "vec_id bigint, embedding array<double>, label int")
    got = hard_negatives(huge, huge.filter("vec_id % 100 = 0")).collect()
    assert {(r.anchor_id, r.positive_id, r.negative_id) for r in got} == {(100, 2, 3)}
    assert got[0].positive_score == 256_000_000 * 512_000_000 + 256 * 256


def test_walk_ends_early_in_tight_clusters():
    rnd = np.random.default_rng(3)
    middle = rnd.normal(size=(20, 16)) * 1000
    vec = np.rint(np.repeat(middle, 200, 0) + rnd.normal(size=(4000, 16)) * 20).astype(np.int64)
    rows = {"id": np.arange(4000), "label": np.arange(4000) % 3, "vec": vec}
    at = np.arange(0, 4000, 50)
    anchors = {"id": at, "label": at % 3, "vec": vec[at], "cluster": hn.cluster(vec[at].astype(float), 20)}
    low = np.full((len(at), 1), -hn.LIMIT)
    i, _, ids, score, made = hn.walk(anchors, rows, low, -low, True, 5)
    assert made < 0.5 * len(at) * 4000
    for a in range(len(at)):
        s = vec @ vec[at[a]]
        ok = np.flatnonzero((rows["label"] == at[a] % 3) & (rows["id"] != at[a]))
        want = ok[np.lexsort((ok, -s[ok]))][:5]
        assert ids[i == a].tolist() == want.tolist()


def test_products_are_exact_beyond_float():
    a = np.array([[2**30, 2**30 + 1]]), np.array([[2**30 - 1, 2**30]])
    assert hn.products(*a)[0, 0] == 2**30 * (2**30 - 1) + (2**30 + 1) * 2**30


# --- Bayesian near duplicates --------------------------------------------


def components_by_definition(texts, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (t or "").translate(low)).split(" ") if x]
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    rows = [(i, shingles(t)) for i, t in texts]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            same = a is not None and a == b and x and y
            both = len(x & y)
            if same or (x and y and 100 * both >= percent * (len(x) + len(y) - both)):
                root[find(i)] = find(j)
    least = {}
    for i, (a, x) in enumerate(rows):
        if a is not None and x:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted(((a, len(x), least.get(find(i)) if x else a) for i, (a, x) in enumerate(rows)), key=str)


def varied(seed, n):
    rnd = random.Random(seed)
    out = []
    for g in range(n):
        words = [f"{g}w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 2, 5, 12, 60, 200]))]
        for _ in range(rnd.randrange(1, 7)):
            w = list(words)
            for _ in range(rnd.randrange(1 + len(w) // 12)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
            out.append((len(out) // 2 * 2 + 3 if rnd.random() < 0.1 else len(out) * 3, " ".join(w)))
    return out + [(None, out[0][1]), (None, "alone here"), (None, None), (1, ""), (2, " \t")]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    rows = varied(k, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"c": F.lit("clash"), "component": F.lit(1), "kept": F.lit(1)})
    got = near_duplicates(df, k, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components_by_definition(rows, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_equal_the_exact_join(spark, docs):
    a = near_duplicates(docs, 2, 80).select("doc_id", "n_shingles", "component_id")
    b = jaccard_components(docs, 2, 80).select("doc_id", "n_shingles", "component_id")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_near_duplicates_edges(spark, edge, nothing):
    got = near_duplicates(edge, 5, 80)
    want = sorted(components_by_definition([(r.doc_id, r.text) for r in edge.collect()], 5, 80), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == want
    assert near_duplicates(nothing).count() == 0


def test_pruning_follows_the_posterior():
    rnd = np.random.default_rng(5)
    for n in bayesdedup.BATCHES:
        m = bayesdedup.least_matches(n, 80, 1e-7)
        # the posterior by numeric integration of s**m (1 - s)**(n - m)
        s = (np.arange(200_000) + 0.5) / 200_000
        for at, over in ((m, True), (m - 1, False)):
            log = at * np.log(s) + (n - at) * np.log1p(-s)
            p = np.exp(log - log.max())
            assert (p[s >= 0.8].sum() / p.sum() >= 1e-7) == over
    left = rnd.integers(0, 1 << 32, (30, 200)).astype(np.uint32)
    right = left.copy()
    change = rnd.random(right.shape) < np.linspace(0, 1, 30)[:, None]
    right[change] = 7
    x, y = bayesdedup.compatible(left, right, 80, 1e-7)
    pairs = set(zip(x.tolist(), y.tolist(), strict=True))
    assert {(i, i) for i in range(7)} <= pairs and not {p for p in pairs if p[0] != p[1]} and (29, 29) not in pairs


def test_signatures_estimate_the_similarity():
    rnd = np.random.default_rng(6)
    common, own = rnd.integers(0, 1 << 63, 4000).astype(np.uint64), rnd.integers(0, 1 << 63, (2, 1000)).astype(np.uint64)
    sets = [np.sort(np.append(common, o)) for o in own]
    sig = bayesdedup.signatures(np.array([0, 5000]), np.concatenate(sets), 2000)
    assert abs((sig[0] == sig[1]).mean() - 4000 / 6000) < 0.04
