"""Tokenizers against their libraries; language ID, licences, neighbours and the pipeline."""

import hashlib
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tapewatch.llm import hnsw, langid, licences
from tapewatch.llm.piecetable import _encode, sentencepiece_documents, table
from tapewatch.llm.queries import op2_language_id
from tapewatch.llm.repair import ShardWords, Words, read_token_shards, replace_pairs, tokenizer, write_token_shards
from tapewatch.llm.tables import hold
from tapewatch.llm.tokencount import count_tokens, cuts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids_of(t, text):
    return [int(x) for s in t.document(text) if s[0] for x in s[0].split(",")]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="theing ▁ \nab日é\x00<s>", max_size=60)))
def test_pieces_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    t = table(PIECES)
    ids = ids_of(t, text)
    assert ids == SP.encode(text)
    assert t.decode(ids) == SP.decode(ids) == "".join(s[2] for s in t.document(text))[1:]


@pytest.mark.parametrize("frame", ["docs", "edge", "nothing"])
def test_sentencepiece_documents(request, frame):
    df = request.getfixturevalue(frame)
    got = sentencepiece_documents(df, PIECES, ["ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"]).collect()
    assert len(got) == df.count()
    for r in got:
        ids = SP.encode(r.text or "")
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), SP.decode(ids) if ids else "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


@pytest.mark.parametrize("frame", ["docs", "edge", "nothing"])
def test_token_counts(request, frame):
    df = request.getfixturevalue(frame)
    for r in count_tokens(df, PIECES, chunk=2000, overlap=64).collect():
        n = len(SP.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 4096)


def test_token_counts_widen_where_nothing_aligns(spark):
    texts = ["a" * 9000, "日本" * 3000, " " * 7000 + "x", "\n" * 5000, "ab" * 5000, "á" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, PIECES, chunk=700, overlap=8).collect()}
    assert got == {i: len(SP.encode(t)) for i, t in enumerate(texts)}


@given(st.text(max_size=200), st.integers(4, 40), st.integers(1, 10))
def test_cuts_cover_and_overlap(text, chunk, overlap):
    raw = text.encode("utf-8", "ignore")
    spans = cuts(raw, chunk + overlap, overlap + 4)
    assert spans[0][0] == 0 and spans[-1][1] == len(raw)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b - overlap and b < d
        raw[c:b].decode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6))
def test_repair_rules_give_the_sequence_back(seq, groups):
    sym, group = np.array(seq, np.int64), np.sort(np.arange(len(seq)) % groups)
    rules = []
    left, owner = replace_pairs(sym, group, None, 2, rules, 10)

    def expand(s):
        return [s] if s < 10 else [y for x in rules[s - 10] for y in expand(x)]

    assert [y for s in left.tolist() for y in expand(s)] == seq
    for g in set(group.tolist()):
        assert [y for s in left[owner == g].tolist() for y in expand(s)] == sym[group == g].tolist()


@pytest.mark.parametrize("frame", ["docs", "edge", "nothing"])
def test_token_files_round_trip(spark, request, tmp_path, frame):
    df, tok = request.getfixturevalue(frame), tokenizer(WORDS)
    path = str(tmp_path / "files")
    write_token_shards(df, path, WORDS, shard_bytes=60_000)
    got = read_token_shards(spark, path, with_ids=True).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    if frame == "docs":
        some = {r.doc_id: r.ids for r in read_token_shards(spark, path, True, 50, 52).collect()}
        assert all(some[w[0]] == w[4] for w in want if 50 <= w[0] <= 52) and len(some) < len(want)


def test_special_strings_and_odd_text_in_files(spark, tmp_path):
    texts = ["a<|endoftext|>b <|startoftext|>", "ΣΑΣ it's 42 é　x\x1cy", "  \n\n ", "<|endo ftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    write_token_shards(df, str(tmp_path / "f"), WORDS)
    got = {r.doc_id: r.ids[:-1] for r in read_token_shards(spark, str(tmp_path / "f"), True).collect()}
    assert got == {i: tokenizer(WORDS).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


ODD = st.text(alphabet="aZzÀÞßéÿ×÷'.,-=;<|>_09 \n\t\x1c\u0301\u0338\u00a0\u0085İΣĀ日", max_size=30)


def test_pieces_are_tokenized_once_and_as_in_the_text():
    """Of a word in other cases and with marks around it only the letters are tokenized, once."""
    words, asked = Words(WORDS), []
    plain = words._encode
    words._encode = lambda new: (asked.extend(new), plain(new))

    def ids_by_text(texts):
        found = ShardWords()
        found.add([t.encode() for t in texts])
        distinct_words, number, counts = found.numbered()
        flat, sizes = words(distinct_words)
        stop = np.cumsum(sizes)
        each = [flat[stop[i] - sizes[i] : stop[i]].tolist() for i in number.tolist()]
        last = np.cumsum(counts)
        return [[x for w in each[e - n : e] for x in w] for e, n in zip(last.tolist(), counts.tolist(), strict=True)]

    tok = tokenizer(WORDS)
    text = "Café, (café) CAFÉ! café; 2024 café/CAFÉ it's \"café\"..."
    assert ids_by_text([text, ""]) == [tok.encode(text, add_special_tokens=False).ids, []]
    assert [w for w in asked if "caf" in w.decode().lower()] == ["café".encode()]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(ODD, max_size=5))
    def check(texts):
        assert ids_by_text(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_language_held_out_accuracy(spark, root):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    r = out.filter("held_out and n_chars > 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.99 and 0 <= r[1] and r[2] <= 1


def test_language_edges(edge, nothing, docs):
    profiles = langid.learn_profiles(docs)
    assert profiles.langs == sorted(profiles.langs)
    got = langid.predict_languages(edge, profiles).collect()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
        assert not letters or r.lang_pred in profiles.langs
    assert langid.predict_languages(nothing, profiles).count() == 0
    empty = langid.learn_profiles(nothing)
    assert empty.langs == [] and {r.lang_pred for r in langid.predict_languages(docs, empty).collect()} == {"und"}


def test_text_vectors_are_sums_of_bound_letters():
    text = "Ab ба,c"
    want = np.zeros(langid.DIM)
    for word in (" ab ", " ба ", " c "):
        for j in range(len(word) - 2):
            v = np.ones(langid.DIM)
            for k, c in enumerate(word[j : j + 3]):
                v = v * np.roll(langid.letter_vector(ord(c)), 2 - k)
            want += v
    assert np.allclose(langid.text_vectors(["", text])[1], want)


def test_licences(spark, docs, edge, nothing):
    model = licences.learn(docs)
    notices = [(i, f"before\n{t}\nafter", f) for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    df = spark.createDataFrame(notices, "doc_id bigint, text string, want string")
    got = licences.scan(df, model).collect()
    right = sum(r.families == r.want and r.licences[0].line == 1 and r.n_paragraphs == 3 for r in got)
    assert right >= 0.9 * len(got)
    fixed = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "All rights reserved.": "proprietary", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    for r in licences.scan(docs, model).collect():
        assert r.families == ",".join(sorted({fixed[x] for x in (r.text or "").split("\n") if x in fixed}))
    clean = ["He had all the rights in the world and reserved a table.", "A licence to fish is needed here.", None, "", "mit"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean)], "doc_id bigint, text string")
    assert [r.n_licences for r in licences.scan(df, model).collect()] == [0] * 5
    assert licences.scan(edge, model).agg(F.sum("n_licences")).first()[0] == 0
    assert licences.scan(nothing, model).count() == 0


def test_licence_anchors_and_plan(docs):
    for ts in licences.GRAMS.values():
        for t in ts:
            assert sum(any(w in licences.ANCHORS for w in g.split()) for g in t) > (1 - licences.CONFIRM) * len(t)
    model = licences.Model(["unknown", "mit"], [0.0, 0.0], {"mit": [0.0, 1.0]}, 1.0)
    plan = licences.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def brute(rows, queries, k):
    out = {}
    for i, q in queries:
        d = sorted((float(np.sqrt(((v.astype(float) - q) ** 2).sum())), j) for j, v in rows if j != i and len(v) == len(q))
        out[i] = d[:k]
    return out


def test_neighbours_recall_and_ties(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    copies = rows.limit(1).select((F.explode(F.sequence(F.lit(100_000), F.lit(100_040)))).alias("vec_id"), "embedding")
    odd = spark.createDataFrame(
        [(200_000, None), (200_001, []), (200_002, [0.0] * 64), (200_003, [float("nan")] * 64), (200_004, [None] * 64), (None, [1.0] * 64), (200_005, [float("inf")] * 64), (200_100, [1.0, 2.0]), (200_200, [1.0, 2.0]), (200_300, [1.0, 4.0])],
        "vec_id bigint, embedding array<float>",
    )
    table_ = rows.unionByName(copies).unionByName(odd).withColumn("rank", F.lit("clash")).cache()
    asked = table_.filter("vec_id % 100 = 0")
    got = hnsw.nearest_neighbours(table_, asked, shard_rows=700).collect()
    good = [(r.vec_id, np.array(r.embedding)) for r in table_.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    want = brute(good, [g for g in good if g[0] % 100 == 0], 10)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(mine) == {i for i, w in want.items() if w}
    hits = sum(len({v for _, v in mine[i]} & {v for _, v in w}) for i, w in want.items() if w)
    assert hits >= 0.97 * sum(map(len, want.values()))
    for i, m in mine.items():
        assert m == sorted(m) and len(m) == len(want[i])
    assert [v for _, v in mine[200_100]] == [200_200, 200_300]
    assert [v for _, v in mine[100_000]] == [v for _, v in want[100_000]]
    assert hnsw.nearest_neighbours(rows.limit(0), rows.limit(0)).count() == 0


def test_pipeline_stages(spark, root, edge):
    df = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, root)
        if name != "sentencepiece":
            assert out.columns == df.columns
        assert out.count() <= df.count()
        df = out.cache()
    assert df.filter("text <> decoded").count() == 0 and df.count() > 150
    rows = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, root)
        assert rows.count() > 0
        rows = rows.cache()


def test_licences_wrapped_and_dual(spark, docs):
    """Notices wrapped at 70 columns, several in one line, and families whose words nearly agree."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    prose = " ".join(f"word{i} thing" for i in range(60))
    wrapped = [(bsd, "bsd"), (gpl.format("", 3), "gpl-3.0"), (gpl.format("", 2), "gpl-2.0"), (gpl.format("Affero ", 3), "agpl-3.0"), (isc, "isc")]
    rows = [("\n".join(["x", "", *(f" * {x}" for x in textwrap.wrap(t, 70)), "", "y"]), f, 2) for t, f in wrapped]
    rows += [
        ("Licensed under the MIT License or the Apache License, Version 2.0.", "apache-2.0,mit", 0),
        (f"{prose} {bsd} {prose} {isc} {prose} Licensed under CC BY-NC 4.0. {prose}", "bsd,cc-by-nc-4.0,isc", 0),
        (f"{bsd} {prose} {bsd}", "bsd", 0),
        ("All rights\n\nin the world\n\nare reserved", "", 0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, want string, begins int")
    got = sorted(licences.scan(df, licences.learn(docs)).collect())
    assert [r.families for r in got] == [r.want for r in got]
    assert all(r.licences[0].line == r.begins for r in got if r.want)
    assert got[7].n_licences == 2


@pytest.mark.parametrize("kind", ["plain", "groups", "near"])
def test_neighbours_recall_in_a_whole_shard(kind):
    """Recall in one shard of 8,192: no clusters, 100 tight groups, and a third of the rows near one vector."""
    n = hnsw.SHARD_ROWS
    x = np.random.default_rng(3).standard_normal((n, 64))
    if kind == "groups":
        x = x[:100][np.arange(n) % 100] + 0.05 * x
    if kind == "near":
        x[: n // 3] = x[0] + 0.05 * x[: n // 3]
    x = x.astype(np.float32)
    q = x[::54]
    got = hnsw.search(x, *hnsw.build(x), q, hnsw.BEAM)
    dist = (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q.astype(float) @ x.T.astype(float)
    hits = [len(set(a) & set(b)) for a, b in zip(np.argsort(dist, 1)[:, :10].tolist(), got.tolist(), strict=True)]
    assert sum(hits) >= 0.99 * 10 * len(q) and min(hits) > 0


def test_a_worker_keeps_no_table_of_another_operator():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])
    list(_encode(PIECES, 1, ["n_tokens"])(iter([batch])))
    assert table.cache_info().currsize == 1
    hold("another", lambda: None)
    assert table.cache_info().currsize == 0


def test_pipeline_stages_bound_the_bytes_of_batches(spark, root):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 2000)").alias("text")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(corpus_pipeline.BATCH)
        stage(spark, spark.read.parquet(f"{root}/documents.parquet"), root)
        assert max(r.n for r in df.mapInArrow(sizes, "n bigint").collect()) < 5 << 20
    spark.conf.unset(corpus_pipeline.BATCH)
