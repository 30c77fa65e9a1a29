"""Line dedup, the n-gram join, PII and decontamination against plain versions."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from tapewatch.llm import pii
from tapewatch.llm.decontaminate import common_subsequence, contaminated, without_contaminated
from tapewatch.llm.linededup import build_mph, dedup_lines, lookup_mph
from tapewatch.llm import ngramjoin
from tapewatch.llm.ngramjoin import Bands, block_product, jaccard_components
from tapewatch.llm.textscan import U64, Scan, mix, shingle_sets

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_lines(rows, least=10):
    key = lambda x: x.strip(WHITE).translate(UP)
    holders = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda k: i is not None and len(k) >= least and len(holders[k]) > 1 and min(holders[k]) != i
        kept = [x for x in lines if not gone(key(x))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame", ["edge", "docs", "nothing"])
def test_line_dedup_equals_plain(request, frame):
    df = request.getfixturevalue(frame)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = dedup_lines(df)
    assert set(df.columns) <= set(got.columns)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == plain_lines(rows)


def test_perfect_hash_is_minimal():
    keys = mix(np.arange(20_000, dtype=U64))
    levels = build_mph(keys)
    assert sorted(lookup_mph(levels, keys).tolist()) == list(range(len(keys)))
    assert (lookup_mph(levels, mix(np.arange(30_000, 31_000, dtype=U64))) < len(keys)).all()


def plain_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = re.findall(f"[^{WHITE}]+", (t or "").translate(UP))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (ia, x) in enumerate(sets):
        for b in range(a):
            ib, y = sets[b]
            near = x and y and 100 * len(x & y) >= percent * len(x | y) and (x == y or None not in (ia, ib))
            if near or (ia == ib and ia is not None and x and y):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return sorted(((i, len(s), low.get(find(a)) if s else i) for a, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("frame", ["edge", "docs", "nothing"])
def test_jaccard_components_equal_plain(request, frame, k, percent):
    df = request.getfixturevalue(frame)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = jaccard_components(df, k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows, k, percent)


def test_jaccard_chains_and_stragglers(spark):
    """A group whose members are not all linked to its smallest: chains, and texts near each other only."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rng.integers(0, 120, i % 9):
            w[j] = f"x{rng.integers(0, 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, percent in ((3, 90), (5, 80), (1, 95)):
        got = jaccard_components(df, k, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows, k, percent)


def test_near_copies_return_few_links(spark, monkeypatch):
    """A group of copies that differ in one word: its blocks return links that join, not all pairs."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        # every group has one opening of 40 words; its members keep 48 to 59 words of the group's own
        opening = [f"o{i}" for i in range(40)]
        base = opening + [f"g{g}{w}" for w in words]
        rows += [" ".join([*base[: 99 - g], f"x{g}y{j}"]) for j in range(25)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    seen = []
    join = ngramjoin.components
    monkeypatch.setattr(ngramjoin, "components", lambda e: seen.append(e.count()) or join(e))
    got = {r.doc_id: r.component_id for r in jaccard_components(df, 3, 90).collect()}
    assert got == {i: i - i % 25 for i in range(300)}
    # 300 rows: a forest has under 300 links; all pairs of the groups are 3600
    assert sum(seen) < 600

def test_near_copies_meet_their_hub_in_few_blocks(spark, monkeypatch):
    """Of copies with one to six words changed the rows sent to blocks stay in proportion to the copies, and no link is lost."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 700):
        own = list(words)
        for at in rng.choice(150, 1 if i % 2 else 6, replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    sent, real = {}, ngramjoin.staged

    def counted(df, name):
        out = real(df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(ngramjoin, "staged", counted)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    number: dict[tuple, int] = {}
    sets = np.zeros((len(rows), 60_000), np.float32)
    for i, t in rows:
        w = t.split()
        for g in zip(w, w[1:], w[2:]):
            sets[i, number.setdefault(g, len(number))] = 1
    both = sets @ sets.T
    n = sets.sum(1)
    linked = 100 * both >= 90 * (n[:, None] + n[None, :] - both)
    want = np.arange(len(rows))
    while True:
        new = np.where(linked, want[None, :], len(rows)).min(1)
        if (new == want).all():
            break
        want = new
    assert got == dict(enumerate(want.tolist())) and 100 < len(set(want)) < 600
    assert 0 < sent["blocks"] <= 2 * sent["rest"] < 14 * len(rows)


@settings(max_examples=30, deadline=None)
@given(st.integers(50, 99), st.lists(st.frozensets(st.integers(0, 30), min_size=1), min_size=2, max_size=8))
def test_block_product_and_bounds(percent, sets):
    bands = Bands(percent, 100)
    arrays = [np.sort(mix(np.array(sorted(s), U64))) for s in sets]
    got = block_product(arrays, arrays, bands)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            linked = 100 * len(a & b) >= percent * len(a | b)
            assert got[i, j] == linked
            if linked:
                lo, hi = sorted((len(a), len(b)))
                c = bands.of(np.array([lo, hi]))
                assert c[1] - c[0] in (0, 1) and len(a ^ b) <= bands.differ[c[0]]


def test_shingles_do_not_depend_on_the_batch():
    texts = [b"A b C d", b"", b"x", b"a B c D e"]
    d, s = shingle_sets(Scan(texts), 3)
    for i, t in enumerate(texts):
        assert (shingle_sets(Scan([t]), 3)[1] == s[d == i]).all()
    assert set(s[d == 0]) < set(s[d == 3])


# the patterns as the contract words them
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@ab-+() %é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_base(text))


def test_base_is_linear_on_long_runs():
    for text in ("a" * 400_000 + " @", "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "@" * 200_000):
        pii.base_spans(text)


def test_personal_data(spark, docs, edge, nothing):
    field = pii.learn_field(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for df in (docs, edge, nothing):
        texts = [r.text for r in df.select("text").collect()]
        got = pii.find_personal_data(df, field).collect()
        assert len(got) == len(texts)
        for r in got:
            base = sorted(plain_base(r.text or ""))
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
            assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
            assert set(pii.joined(base).split(",")) <= set(r.spans.split(",")) or not base
    # what the patterns lose because a number runs into its neighbour
    text = "pay 4041894974608795 43 now, mail ab.cd@mail8.example.com or ring +1 (988) 555-2485 today"
    base = pii.base_spans(text)
    assert (2, 4, 20) not in base and (2, 4, 20) in base + field.spans(text, base)
    clean = "Version 2.0 of 15 June 2021, see page 12 and table 3.4 or call on us at 10 a m"
    assert not field.spans(clean, pii.base_spans(clean))


def test_field_agrees_with_enumeration():
    """Best segmentation and marginals of a random field against all segmentations of short regions."""
    import itertools
    import math
    import random

    random.seed(2)
    f = pii.Field()
    f.t = [[random.uniform(-1, 1) for _ in row] for row in f.t]
    n = 4
    score = {(i, m, k): random.uniform(-2, 2) for i in range(n) for m in range(1, min(pii.MOST_TOKENS, n - i) + 1) for k in range(5) if k or m == 1}

    def every(i):
        if i == n:
            yield []
        for m in range(1, n - i + 1):
            for k in range(5):
                if (i, m, k) in score:
                    yield from ([(i, m, k), *rest] for rest in every(i + m))

    def value(segs):
        return sum(score[s] + f.t[p[2]][s[2]] for p, s in itertools.pairwise([(0, 0, 0), *segs]))

    all_ = list(every(0))
    assert f.best(n, score) == max(all_, key=value)
    z = sum(math.exp(value(s)) for s in all_)
    want = collections.Counter()
    for s in all_:
        for p, x in itertools.pairwise([(0, 0, 0), *s]):
            want[(*x, p[2])] += math.exp(value(s)) / z
    got = f.marginals(n, score)
    assert all(abs(got.get(k, 0) - v) < 1e-9 for k, v in want.items())


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert common_subsequence(np.array(a, np.int64), np.array(b, np.int64)) == t[-1][-1]


def test_decontamination_finds_every_item(spark, docs, root, edge, nothing):
    bench = spark.read.parquet(f"{root}/benchmark.parquet")
    norm = lambda t: f" {' '.join(re.findall(f'[^{WHITE}]+', (t or '').translate(UP)))} "
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(i, q) for i, t in texts for q, x in items.items() if x in norm(t)}
    got = contaminated(docs, bench).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    assert all(r.lcs >= 0.5 * r.item_words for r in got)
    # paraphrase: every sixth word replaced; and a text with the item's words in another order
    item = next(t for t in items.values() if len(t.split()) >= 30).split()
    changed = [f"new{i}" if i % 6 == 5 else w for i, w in enumerate(item)]
    filler = [f"filler{i}" for i in range(40)]
    rows = [(1, " ".join(filler + changed + filler)), (2, " ".join(filler + sorted(item))), (3, " ".join(filler)), (4, None), (None, "x"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").union(docs.select("doc_id", "text").filter("doc_id > 100"))
    assert 1 in {r.doc_id for r in contaminated(df, bench).filter("doc_id < 6").collect()}
    left = {r.doc_id for r in without_contaminated(df, bench).filter("doc_id is null or doc_id < 6").collect()}
    assert left == {2, 3, 4, 5, None}
    assert contaminated(edge, bench).count() == 0
    assert contaminated(nothing, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_own_names_do_not_clash(spark, edge):
    """Columns named like those the operators use inside come back untouched."""
    from tapewatch.llm.queries import vocabulary
    from tapewatch.llm.tokencount import count_tokens

    odd = ("__id", "__gone", "__key", "key", "line", "shard", "h1", "h2", "part", "parts", "id", "n", "sig", "rep", "tokens")
    df = edge.withColumns({c: F.lit("clash") for c in odd})
    for got in (dedup_lines(df), count_tokens(df, vocabulary("piece_bpe_32k.model"), chunk=400)):
        assert got.count() == df.count()
        assert got.filter(" or ".join(f"`{c}` <> 'clash'" for c in odd)).count() == 0


def test_keys_with_equal_first_hashes(spark):
    """Of line keys that share their first hash every one keeps its own count and owner."""
    import pandas as pd

    from tapewatch.llm.linededup import _build, _probe, both

    rows = pd.DataFrame({"h1": [5, 5, 5, 9], "h2": [1, 2, 3, 1], "owner": [10, 20, 30, 40], "n": [2, 1, 2, 2], "shard": 0})
    probes = pd.DataFrame({"h1": [5, 5, 5, 9, 5], "h2": [1, 2, 3, 1, 3], "doc_id": [11, 21, 31, 41, 30]})
    got = _probe(probes, _build(rows))
    assert sorted(got["doc_id"]) == [11, 31, 41]
    assert got.set_index("doc_id")["line"][31] == both(np.array([5], U64), np.array([3], U64)).view(np.int64)[0]


def test_short_items_are_found_among_many(spark, docs):
    """Items of 4 to 15 words, copied word for word, among two thousand; and nothing is reported without the words."""
    import random

    from tapewatch.llm.decontaminate import PART, word_hashes

    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and len(r.text.split()) > 20]
    rnd, items = random.Random(4), []
    for i in range(2000):
        doc, text = rnd.choice(rows)
        words, n = text.split(), 4 + i % 12
        at = rnd.randrange(len(words) - n)
        items.append((i, " ".join(words[at : at + n]), doc))
    got = contaminated(docs, spark.createDataFrame([x[:2] for x in items], "item_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert {(d, i) for i, _, d in items} <= pairs
    text, item = dict(rows), {i: t for i, t, _ in items}
    for r in got:
        a, b = word_hashes([item[r.item_id].encode()])[0], word_hashes([text[r.doc_id].encode()])[0]
        assert PART * len(a) <= r.lcs <= common_subsequence(a, b) and r.item_words == len(a)


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    """Rows (1, S2), (7, S1), (7, S2), (9, near S1): 9 reaches 1 through 7, whichever text the link is with."""
    s1, s2 = ([f"{c}{i}" for i in range(120)] for c in "ab")
    near = [*s1[:-1], "other"]
    rows = [(i, " ".join(w)) for i, w in ((1, s2), (7, s1), (7, s2), (9, near), (10, ["else"] * 30))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (7, 1), (7, 1), (9, 1), (10, 10)]


def test_row_sums_of_short_long_and_empty_groups():
    from tapewatch.llm.decontaminate import LONG, Vocabulary, row_sums

    rnd = np.random.default_rng(3)
    size = np.array([0, 1, 3 * LONG, 0, LONG, LONG + 1, 2, 2, 5, 0])
    begin = np.append(0, np.cumsum(size))
    table, index, weight = rnd.standard_normal((50, 7)), rnd.integers(0, 50, begin[-1]), rnd.standard_normal(begin[-1])
    groups = list(zip(begin[:-1], begin[1:]))
    assert np.allclose(row_sums(table, index, begin), [table[index[a:b]].sum(0) for a, b in groups])
    assert np.allclose(row_sums(table, index, begin, weight), [(table[index[a:b]] * weight[a:b, None]).sum(0) for a, b in groups])
    vocab = np.unique(rnd.integers(0, 2**63, 300).astype(U64) * U64(2) + U64(1))
    h = np.concatenate([vocab[::3], vocab[::5] + U64(1), rnd.integers(0, 2**63, 500).astype(U64)])
    place, word = Vocabulary(vocab)(h)
    assert place.tolist() == np.flatnonzero(np.isin(h, vocab)).tolist() and (vocab[word] == h[place]).all()


def test_passages_near_an_item_are_counted_together():
    """Calls made in a search do not follow the pairs of a passage and an item part that are near (some 70,000 here)."""
    import cProfile
    import pstats

    import pyarrow as pa

    from tapewatch.llm.decontaminate import COSINE, Items, _search

    rnd = np.random.default_rng(1)
    items = Items.of([(i, " ".join(f"w{k}" for k in rnd.choice(300, 40, replace=False))) for i in range(60)])
    # one direction: every passage is near every part
    space = np.abs(rnd.standard_normal((len(items.vocab), 4))).astype(np.float32) + np.float32(COSINE)
    texts = [" ".join(f"w{k}" if k < 300 else "x" for k in rnd.integers(0, 900, 1600)) for _ in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    p = cProfile.Profile()
    found = p.runcall(lambda: sum(b.num_rows for b in _search(items, space)(iter([batch]))))
    assert found == 0 and pstats.Stats(p).total_calls < 20_000


@pytest.mark.parametrize("repeats", [False, True])
def test_entries_leave_in_small_batches(repeats):
    """A task holds a million entries; no batch it gives out has more than a few rows of them."""
    texts = [" ".join(f"w{i % 300}x{j}" for j in range(300)) + f" end{i}" for i in range(600)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], ["id", "text"])
    out = list(ngramjoin._entries(5, 0, Bands(80, 100), np.zeros(0, U64), repeats)(iter([whole])))
    rows = [b.num_rows for b in out]
    assert sum(rows) > 1 << 16 >= max(rows)
    got = pa.Table.from_batches(out).to_pandas()
    if repeats:
        assert got.need.isna().sum() > 1 << 16 and got.need.count() == 1200
    else:
        # each entry once, twice if several rows have it
        assert got.groupby("sig").size().max() == 2 and not got.sig.is_monotonic_decreasing
