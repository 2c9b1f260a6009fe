"""Cases in which an operator once did less than the whole job."""

import pytest
from pyspark.sql import functions as F

ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 */
package org.example;
"""
GPL = """# Copyright (C) 2020 A. Writer
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
import os
"""
BSD = """// Copyright 2014 The Project Authors. All rights reserved.
// Use of this source code is governed by a BSD-style license that can be
// found in the LICENSE file.

int main() { return 0; }
"""


def test_license_headers_and_full_texts(spark):
    from tesserae.llm.licenses import BODIES, license_scan

    code = "\n".join(f"int value{k} = compute{k}(a{k}, b{k});" for k in range(400))
    cases = [("Apache-2.0", ASF + code), ("GPL-3.0", GPL.format(3) + code), ("GPL-2.0", GPL.format(2) + code), ("BSD-3-Clause", BSD + code), ("MIT", "// SPDX-License-Identifier: MIT\n" + code), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */\n" + code), ("Apache-2.0 OR MIT", "# SPDX-License-Identifier: Apache-2.0 OR MIT\n" + code)]
    cases += [("MIT", "\n".join(f" * {line}" for line in BODIES["MIT"].splitlines()) + code), ("BSD-3-Clause", "\n".join(f"# {line}" for line in BODIES["BSD-3-Clause"].splitlines()) + "\n" + code), (None, code), (None, "We were licensed to fish there, with permission.")]
    rows = [(k, f"/src/{k}/f", text) for k, (_, text) in enumerate(cases)]
    rows += [(100 + k, f"/files/{name}/LICENSE", "Copyright (c) 2021 Somebody Else\n\n" + text) for k, (name, text) in enumerate(BODIES.items())]
    rows += [(200 + k, f"/files/{name}/deep/f", "nothing") for k, name in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert [got[k]["own_license"] for k in range(len(cases))] == [name for name, _ in cases]
    assert not any(got[k]["is_license_file"] for k in range(len(cases)))
    for k, name in enumerate(BODIES):
        assert (got[100 + k]["own_license"], got[100 + k]["is_license_file"]) == (name, True)
        assert (got[200 + k]["license"], got[200 + k]["license_dir"]) == (name, f"/files/{name}")


def test_nearest_among_many_copies(spark):
    """A file holds far more equal vectors than are reranked; ties go to the smallest ids."""
    import brute
    import numpy as np

    from tesserae.llm.ann import nearest

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[rng.random(len(x)) < 1 / 3] = x[0]
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    copied = {i for i, v in zip(ids, x) if (v == x[0]).all()}
    assert len(copied) > 1280
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    asked = [q for q in got if q in copied]
    assert len(asked) > 20 and all(got[q] == sorted(copied - {q})[:5] for q in asked)
    expected = brute.nearest(rows)
    others = [q for q in expected if q not in copied]
    assert sum(len(set(got[q]) & {i for i, _ in expected[q]}) for q in others) >= 0.9 * 5 * len(others)


@pytest.mark.parametrize("case", ["empty", "all null", "no text"])
def test_nothing_is_toxic_without_labels(spark, case):
    from tesserae.llm.toxicity import toxicity, train, without_toxic

    docs = spark.createDataFrame([(k, f"some words {k % 3} of a text") for k in range(40)] + [(None, None)], "doc_id long, text string")
    rows = [] if case == "empty" else [(k if case == "all null" else 1000 + k, k % 2, None if case == "all null" else 1) for k in range(40)]
    chain = train(docs, spark.createDataFrame(rows, "doc_id long, low_quality int, toxic int"), ["low_quality", "toxic"])
    assert without_toxic(docs, chain).count() == 41
    assert toxicity(docs, chain).filter("rejected or p_toxic > 0").count() == 0


def test_one_row_of_each_group_of_copies(spark):
    """Rows that repeat, rows without an id, and an id with a clean text besides a copy."""
    import corpus_pipeline as p

    copy, other, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, copy, "x"), (2, copy, "x"), (2, other, "x"), (3, third, "z"), (3, third, "y"), (3, third, "y"), (None, third + " end", "x")]
    rows += [(None, "no id but words enough to be a text", s) for s in "ba"] + [(None, None, "x"), (None, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("k")).repartition(3)
    got = dict(p.STAGES)["near_dedup"](spark, docs, None)
    assert got.columns == docs.columns
    expected = [(1, copy, "x"), (2, other, "x"), (3, third, "y"), (None, "no id but words enough to be a text", "a"), (None, None, "x"), (None, "", "x"), (5, "", "x")]
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, expected))


def test_low_percent_is_refused(spark):
    from tesserae.llm.near_dup import near_duplicates

    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=70)


def test_near_duplicates_in_groups_that_stay_in_parts(spark):
    """Large documents on one template, far more than a tile holds, few of which are near copies of each other: estimates connect all, links few."""
    import brute

    from tesserae.llm.near_dup import TILE_DOCS, WHOLE, near_duplicates

    base = [f"t{k}" for k in range(150)]
    rows = [(k, " ".join(base + [f"own{k}_{j}" for j in range(60)])) for k in range(TILE_DOCS + 60)]
    assert len(rows[0][1].split()) > WHOLE
    # near copies of some, chains of near copies, and one between two documents
    rows += [(1000 + k, rows[7 * k][1] + " and a little more") for k in range(30)]
    rows += [(2000 + k, " ".join(base + [f"own3_{j}" for j in range(7 * k, 7 * k + 60)])) for k in range(12)]
    rows += [(3000, " ".join(base + [f"own5_{j}" for j in range(40)] + [f"own6_{j}" for j in range(40)]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=4).collect()}
    expected = brute.near_duplicates(rows, 4)
    assert got == expected
    assert 200 < len({c for _, c in expected.values()}) < len(rows) - 40


def test_encoder_keeps_its_table_small_and_cuts_long_texts():
    """Texts without ASCII white space, long words and other spaces; ids equal the library's."""
    import brute
    import numpy as np

    from tesserae.llm import tokens

    rng = np.random.default_rng(3)
    kana = "".join(rng.choice(list("日本語のテキスト、。！漢字かなカナ〜a1 \u3000\u0301が"), 380_000, p=[0.02] + [0.05] * 18 + [0.05, 0.0005, 0.0015, 0.002, 0.026]))
    wide = " ".join(f"w{x}\u00a0x,{x}" if x % 7 else f"<|endoftext|> it's {x}" for x in rng.integers(0, 99999, 70_000))
    words = "\n".join(f"{x:x}" * (1 + 40 * (x % 50 == 0)) for x in rng.integers(0, 1 << 60, 60_000))
    assert all(len(t.encode()) > tokens.SEGMENT for t in (kana, wide, words))
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        encoder, library = tokens.Encoder(tokens.tokenizer_path(name), kind), brute.tokenizer(name)
        texts = [kana, wide, words, None, "", "short\ttext", "。か", words[:9] + "、" + kana[:50]]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(t and t.encode() for t in texts)]
        assert got == [brute.token_ids(library, t) for t in texts]
        list(encoder.ids(f"{x:x} {x:o}".encode() for x in rng.integers(0, 1 << 60, 150_000)))
        held = sum(len(k) + len(v) + tokens.ENTRY for k, v in encoder.table.items() if len(k) <= tokens.LONGEST)
        assert held == encoder.held <= tokens.TABLE_BYTES + 64 * tokens.SEGMENT and len(encoder.long) < 1000


def test_equal_vectors_have_equal_scores(spark):
    """Whatever their place among others; ids of equal vectors are ranked by id."""
    import numpy as np

    from tesserae.llm.ann import cosines, nearest

    rng = np.random.default_rng(11)
    for n in (1, 3, 8, 37):
        x, q = rng.normal(size=(n, 64)), rng.normal(size=(2, 64))
        x[:] = x[0]
        assert all(len(set(c)) == 1 for c in cosines(q, np.stack([x, x])))
    x = rng.normal(size=64).tolist()
    rows = [(1000, rng.normal(size=64).tolist())] + [(k, x) for k in range(1, 39)]
    got = [(r["rank"], r["vec_id"]) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(k, k) for k in range(1, 6)]


def test_nearest_reads_part_of_the_index():
    """Recall of the footrule ranking on random vectors, the hardest, whose files are cut by half."""
    import numpy as np

    from tesserae.llm.ann import footrule, ordered_pivots

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16))
    order = ordered_pivots(x, x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True), 20)
    rank = np.full((200, 50), 20)
    for k, row in enumerate(order):
        rank[k, row] = np.arange(20)
    plain = np.abs(rank[:, None, :] - rank[None, :, :]).sum(axis=2)
    got = footrule(order, order, 50)
    assert (np.argsort(got[3], kind="stable") == np.argsort(plain[3], kind="stable")).all() and len(set((plain - got).ravel())) == 1


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tesserae.llm.common import shared_dir

    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn")))


def test_nearest_with_few_candidates_and_repeated_ids(spark):
    """All candidates where they are fewer than k; rows that share an id are one candidate, its best."""
    from tesserae.llm.ann import nearest

    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.707107), (0, 2, 2, -1.0)]


def test_toxicity_of_null_and_repeated_rows(spark):
    """Repeated labels count as positive if any is; rows with null ids and texts are scored; equal texts get equal scores."""
    from tesserae.llm.toxicity import toxicity, train

    docs = spark.createDataFrame([(k, f"vile nasty words {k}" if k % 3 == 1 else f"kind gentle words {k}") for k in range(60)] + [(None, "vile nasty words"), (None, None), (4, "vile nasty words 4")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, int(k % 3 == 1)) for k in range(60)] + [(k, 0, 0) for k in range(60)] + [(None, 1, 1)], "doc_id long, low_quality int, toxic int")
    got = toxicity(docs, train(docs, labels, ["low_quality", "toxic"])).collect()
    assert len(got) == 63
    assert {r["doc_id"] for r in got if r["rejected"]} == {None, *range(1, 60, 3)} and sum(r["doc_id"] is None and r["rejected"] for r in got) == 1
    assert len({r["p_toxic"] for r in got if r["doc_id"] == 4}) == 1


def test_mixing_of_null_and_repeated_ids(spark):
    from tesserae.llm.mixing import first_words, mix

    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (1, "one two three four", "y"), (1, "one two three four", "y"), (2, "w " * 50, None), (3, None, None), (4, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    for target in {r["target"] for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == target) - target) <= 0.5
    cut = docs.filter("doc_id = 1").select(first_words(F.lit(" a  b\n c d"), F.lit(3)).alias("t")).first()["t"]
    assert cut == " a  b\n c"


def test_contexts_in_very_long_texts(spark):
    """Words before and after an identifier are found however far off, and without reading the text anew for each."""
    from tesserae.llm.common import Cuts
    from tesserae.llm.pii import personal_data

    gap, filler = " " * 5000, " ".join(f"w{k}" for k in range(200_000))
    rows = [(k, f"{filler if k == 7 else ''} my account number:{gap}+44 20 7946 0{k:03d}{gap}is in use {filler if k == 8 else ''}") for k in range(40)]
    rows += [(100, f"{filler} my account number:{gap}020-7946-0958{gap}is in use"), (101, f"{filler} some other thing: 020-7946-1111 then")]
    found = {r["id"]: [(s["kind"], s["end"] - s["start"]) for s in r["spans"]] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string"), Cuts(spark, "test")).collect()}
    assert found[100] == [(3, 13)] and found[101] == [] and all((3, 16) in found[k] for k in range(40))


def test_words_go_to_the_library_without_separators():
    """Each new word once and bare, also across tables that start anew; ids equal the library's."""
    import brute
    import numpy as np

    from tesserae.llm import tokens

    encoder, library, asked = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"), "byte"), brute.tokenizer("byte_bpe_50k.json"), []
    ids = encoder._ids
    encoder._ids = lambda texts: asked.extend(texts) or ids(texts)
    texts = ["foo bar, foo", " bar  foo\n", "foo \x01 it's\tbar, é<|endoftext|>é ", "bar, Ġ foo"]
    for _ in range(3):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(t.encode() for t in texts)]
        assert got == [brute.token_ids(library, t) for t in texts]
        encoder.table.held = tokens.TABLE_BYTES
    words = [w for t in asked for w in t.split(" ") if w]
    assert words.count("it's") == words.count("Ġ") == 1 and all(tokens.MARK not in t for t in asked if "it's" not in t and "Ġ" in t)
