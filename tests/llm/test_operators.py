"""The numbered operators against plain versions, on the smallest tables and on rows made to be awkward."""

import math

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ("id", "rep", "mark", "spans", "found_id", "repeats", "taken_id", "nth", "target", "vec", "component_id", "kept")
LONG = " ".join(f"word{k % 977} mail{k}@example.org, and 10.0.{k % 256}.7" if k % 50 == 0 else f"w{k * k % 5003}" for k in range(40_000))
AWKWARD = [
    (9001, None, "src0"), (9002, "", "src0"), (9003, " \t\n ", None), (9004, LONG, "src1"), (9005, LONG + " and a few more", None),
    (9006, "two words", "src1"), (9007, "TWO\tWords", "src1"), (9008, "İ ΑΣ two words \x1c <|ENDOFTEXT|> <|endoftext|>,", "src2"),
    (9009, "card 4111 1111 1111 1111, 4111 1111 1111 1112; call +44 20 7946 0958 or a@b.co..uk 256.1.1.1 1.2.3.4.5", "src2"),
]


def extra(df):
    """The frame with columns whose names operators use themselves."""
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


@pytest.fixture(scope="module")
def rows(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    return [tuple(r) for r in plain] + AWKWARD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return extra(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def null_ids(spark):
    """Rows without an id, and repeated rows."""
    return spark.createDataFrame([(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"), (7, "other words of the same id"), (8, "A B c d e f")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))


def test_near_duplicates(docs, rows, null_ids, empty):
    from tesserae.llm.near_dup import near_duplicates

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, width=4).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.near_duplicates([r[:2] for r in rows], 4).items()}
    odd = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(null_ids).filter("doc_id is not null").collect())
    assert odd == [(7, 2, 7, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False)]
    assert [r["kept"] for r in near_duplicates(null_ids).filter("doc_id is null").collect()] == [True, True]
    assert near_duplicates(empty).collect() == []


def test_near_duplicates_in_large_groups(spark):
    """Chains, a passage that all documents share, and more copies than a tile holds."""
    from tesserae.llm.near_dup import TILE_DOCS, near_duplicates

    base = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:58], f"x{k}", f"y{k}"])) for k in range(TILE_DOCS + 40)]
    rows += [(1000 + k, " ".join([*base[:12], *(f"own{k}_{j}" for j in range(40))])) for k in range(60)]
    rows += [(2000 + k, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 80))) for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute.near_duplicates(rows, 4)


@pytest.fixture(scope="module")
def vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = [(r[0], r[1], r[2]) for r in table.collect()]
    first = rows[0][1]
    near = [x * (1 + 0.01 * (k % 3)) for k, x in enumerate(first)]
    rows += [(9000, first, rows[0][2]), (9001, near, rows[0][2]), (9002, near, None), (9003, [-x for x in first], rows[0][2])]
    rows += [(9050, None, 1), (9100, [0.0] * 64, 1), (9150, [math.nan] + first[1:], 1), (9200, [None] + first[1:], 1), (9250, [math.inf] + first[1:], 1), (9300, [1.0, 2.0], 1), (9350, [x * 1e200 for x in first], rows[0][2])]
    return rows, extra(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def test_embedding_duplicates(vectors):
    from tesserae.llm.embed_dup import embedding_duplicates

    rows, df = vectors
    expected = brute.embedding_links([(i, [x / 1e200 for x in v] if i == 9350 else v, lab) for i, v, lab in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(df, tile=16).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in expected.items()}
    assert embedding_duplicates(df.limit(0)).collect() == []


def test_nearest(vectors):
    from tesserae.llm.ann import nearest

    rows, df = vectors
    expected = brute.nearest([(i, [x / 1e200 for x in v] if i == 9350 else v) for i, v, _ in rows])
    found = {}
    for r in sorted(nearest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {q for q, e in expected.items() if e}
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in found)
    assert hits >= 0.9 * sum(len(e) for e in expected.values())
    for q, e in expected.items():
        exact = dict(e)
        assert all(abs(s - exact[i]) < 1e-12 for i, s in found.get(q, []) if i in exact)
    assert nearest(df.limit(0)).collect() == []


def test_token_counts(docs, rows, empty, null_ids):
    from tesserae.llm.token_counts import token_counts
    from tesserae.llm.tokens import tokenizer_path

    path, library = tokenizer_path("word_bpe_49k.json"), brute.tokenizer("word_bpe_49k.json")
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts(docs, path, "word").collect()}
    n = {i: len(brute.token_ids(library, t)) for i, t, _ in rows}
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 2048) for i, t, _ in rows}
    assert token_counts(empty, path, "word").collect() == [] and token_counts(null_ids, path, "word").count() == 6


def test_packing(docs, rows, empty, null_ids):
    from tesserae.llm.packing import pack
    from tesserae.llm.tokens import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    got = [tuple(r) for r in pack(docs, path, "word").collect()]
    assert brute.check_packing(got, [r[:2] for r in rows], brute.tokenizer("word_bpe_49k.json")) < 0.05
    assert pack(empty, path, "word").collect() == [] and pack(null_ids, path, "word").count() == 6


def test_token_files(spark, docs, rows, empty, null_ids, tmp_path):
    from tesserae.llm.token_files import document_ids, read_token_files, write_token_files
    from tesserae.llm.tokens import tokenizer_path

    path, library = tokenizer_path("byte_bpe_50k.json"), brute.tokenizer("byte_bpe_50k.json")
    folder = str(tmp_path / "store")
    write_token_files(docs, folder, path, "byte", 2)
    got, at = {r["id"]: r for r in read_token_files(spark, folder, with_ids=True).collect()}, 0
    assert len(got) == len(rows)
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = brute.token_ids(library, t, 2)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["ids"]) == (at, len(ids), brute.crc(ids), ids)
        at += len(ids)
    assert document_ids(spark, folder, 9006) == brute.token_ids(library, "two words", 2) and document_ids(spark, folder, -1) is None
    for k, frame in enumerate((empty, null_ids)):
        write_token_files(frame, f"{folder}{k}", path, "byte", 2)
        assert read_token_files(spark, f"{folder}{k}").count() == frame.count()


def test_personal_data(spark, docs, rows, empty, null_ids):
    from tesserae.llm.common import Cuts
    from tesserae.llm.pii import KINDS, as_text, personal_data, redacted

    found = {r["id"]: r for r in personal_data(docs, Cuts(spark, "test")).withColumns({"b": as_text(F.col("base")), "s": as_text(F.col("spans"))}).collect()}
    for i, t, _ in rows:
        plain = [f"{KINDS[k]}:{s}:{e}" for s, k, e in brute.base_spans(t)]
        assert found[i]["b"].split(",") == (plain or [""])
        assert set(plain) <= set(found[i]["s"].split(","))
    assert personal_data(empty, Cuts(spark, "test")).collect() == [] and personal_data(null_ids, Cuts(spark, "test")).count() == 6
    clean = redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[9001] is None and text[9009].startswith("card [CARD], 4111 1111 1111 1112; call [PHONE] or [EMAIL]..uk")


def test_contexts_discover_identifiers(spark):
    from tesserae.llm.common import Cuts
    from tesserae.llm.pii import personal_data

    rows = [(k, f"please call phone number: +44 20 7946 0{k:03d} today") for k in range(40)] + [(100, "please call phone number: 020-7946-0958 now"), (101, "the other thing was 020-1111-0958 then")]
    found = {r["id"]: r["spans"] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string"), Cuts(spark, "test")).collect()}
    assert [(s["start"], s["kind"], s["end"]) for s in found[100]] == [(26, 3, 39)] and found[101] == []


@pytest.mark.parametrize("with_labels", [True, False])
def test_mixing(spark, docs, rows, empty, with_labels, tmp_path):
    from tesserae.llm.mixing import OP7_SQL, mix, quality_weights

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels if with_labels else labels.limit(0)
    con = duckdb.connect()
    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "d"))
    labels.write.parquet(str(tmp_path / "l"))
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    con.sql(f"create view labels as select * from '{tmp_path}/l/*.parquet'")
    expected = sorted(con.sql(OP7_SQL).fetchall())
    got = sorted(tuple(r) for r in mix(docs, qualities=quality_weights(labels)).drop("repeats", "part").collect())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in expected]
    assert all(abs(a[3] - b[3]) < 1e-6 * max(1, b[3]) and a[4] <= 3 * a[1] for a, b in zip(got, expected))
    for size, target, taken in {(r[2], r[3], sum(x[4] for x in got if x[2:4] == r[2:4])) for r in got}:
        assert abs(taken - target) <= 0.5 or not size
    assert mix(empty).collect() == []


def test_license_scan(spark):
    from tesserae.llm.licenses import TEMPLATES, license_scan

    rows = [(k, f"/p/{name}/f", f"Some words. {text} More words follow here") for k, (name, text) in enumerate(TEMPLATES.items())]
    rows += [(50, "/a/LICENSE", "Released under the MIT License."), (51, "/a/b/c/x", "nothing"), (52, "/a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (53, "/a/y", ""), (54, None, None), (55, "/q/z", "no license is spoken of here"), (None, "/a/b/w", None)]
    df = extra(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["license_dir"]) for r in license_scan(df).collect()}
    for k, name in enumerate(TEMPLATES):
        assert got[k] == (name, name, None)
    assert got[51] == (None, "CC-BY-NC-4.0", "/a/b") and got[None] == (None, "CC-BY-NC-4.0", "/a/b")
    assert got[53] == (None, "MIT", "/a") and got[54] == (None, None, None) and got[55] == (None, None, None)
    assert license_scan(df.limit(0)).collect() == []


def test_toxicity(spark, docs, empty):
    """Accuracy on documents that the chain wasn't fitted on; a few labels are wrong."""
    from tesserae.llm.toxicity import toxicity, train, without_toxic

    big = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = train(table.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 > 0"), ["low_quality", "toxic"])
    held = labels.filter("doc_id % 3 = 0").select("doc_id", "toxic")
    scored = [(r["rejected"], r["toxic"] == 1) for r in toxicity(table.join(held.select("doc_id"), "doc_id", "left_semi"), chain).join(held, "doc_id").collect()]
    assert len(scored) > 100 and sum(a == b for a, b in scored) >= 0.95 * len(scored)
    assert sum(a and not b for a, b in scored) <= 0.02 * len(scored)
    assert without_toxic(docs, chain).columns == docs.columns
    assert toxicity(docs, chain).count() == docs.count() and toxicity(empty, chain).collect() == []
    assert train(empty, labels, ["low_quality", "toxic"]).weights[0] == {}


def test_components(spark):
    from tesserae.llm.common import Cuts
    from tesserae.llm.components import connected_components

    edges = [(k, k + 1) for k in range(50)] + [(100, 100), (200, None), (300, 301), (301, 300), *((400, k) for k in range(401, 440))]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Cuts(spark, "test")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 300: 300, 301: 300, **{k: 400 for k in range(400, 440)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Cuts(spark, "test")).collect() == []


def test_encoders_agree_with_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tesserae.llm.tokens import Encoder, tokenizer_path

    parts = st.sampled_from(["the", "The", " ", "  ", "\n", "\t", "'s", "don't", ",", "...", "é", "é", "́", "Σ", "İ", "12", "a1", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "\x01", " ", "\x1c", "　", "日本", "😀", "I", "̇", "_", "-"])
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        encoder, library = Encoder(tokenizer_path(name), kind), brute.tokenizer(name)

        @settings(max_examples=250, deadline=None, database=None)
        @given(st.lists(st.lists(parts, max_size=12).map("".join), max_size=3))
        def agree(texts):
            raw = [t.encode() for t in texts]
            expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
            assert [list(memoryview(x).cast("I")) for x in encoder.ids(raw)] == expected
            assert list(encoder.counts(raw)) == [len(x) for x in expected]

        agree()


def test_pairs_of_near_tiles(spark):
    """All pairs of boxes within reach and no others, whatever their levels; compared with every pair."""
    import numpy as np

    from tesserae.llm.embed_dup import BOXED, _near_tiles

    rng, reach = np.random.default_rng(4), 0.2
    low = np.round(rng.uniform(-1, 1, (150, BOXED)), 3)
    wide = rng.uniform(0, 0.05, (150, BOXED)) * (rng.random((150, BOXED)) < 0.7) + (rng.random((150, BOXED)) < 0.1)
    low[:, 4:] *= 0.1
    boxes = [(k, k % 2, 64, low[k].tolist(), (low[k] + wide[k]).tolist()) for k in range(150)]
    got = sorted(tuple(sorted((r["tile_a"], r["tile_b"]))) for r in _near_tiles(spark.createDataFrame(boxes, "tile long, label int, dim int, lo array<double>, hi array<double>"), reach).collect())
    gap = lambda a, b: sum(max(0.0, x0 - y1, y0 - x1) ** 2 for x0, x1, y0, y1 in zip(a[3], a[4], b[3], b[4]))
    assert got == sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] <= b[0] and a[1] == b[1] and gap(a, b) <= reach * reach)


def test_embedding_duplicates_of_null_and_repeated_ids(spark):
    from tesserae.llm.embed_dup import embedding_duplicates

    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [1.0, 0.1], 1), (6, [1.0, 0.0], None), (7, [0.0, 1.0], 1)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(0, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 0, 6, True), (7, 0, 7, True)]
