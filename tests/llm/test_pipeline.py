"""Each stage on awkward rows, and the whole on the smallest tables."""

import brute
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "words without an id", "en", "src0", 19), (9001, "", "en", None, 0), (9002, None, None, "src1", None)], plain.schema)
    return plain.unionByName(odd)


def test_stages(spark, docs):
    import corpus_pipeline as p

    stages, columns = dict(p.STAGES), docs.columns
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == columns and kept.filter("doc_id is null").count() == 2
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept.join(labels.filter("toxic = 0"), "doc_id").count() >= 0.98 * labels.filter("toxic = 0").count()

    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").collect()]
    groups = brute.near_duplicates(rows, 5)
    got = stages["near_dedup"](spark, docs, SF)
    assert got.columns == columns
    assert {r["doc_id"] for r in got.select("doc_id").filter("doc_id is not null").collect()} == {i for i, (_, c) in groups.items() if i == c}

    clean = stages["personal_data"](spark, docs, SF)
    assert clean.columns == columns and clean.count() == docs.count()
    assert all(not brute.base_spans(r["text"]) or "@" not in r["text"] for r in clean.filter("text is not null").collect())

    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().filter("doc_id is not null").agg(F.max("count")).first()[0] <= 3

    packed = stages["packing"](spark, docs, SF)
    got = [tuple(r) for r in packed.filter("doc_id is not null").collect()]
    assert {r[0] for r in got} == {i for i, _ in rows}


def test_whole_and_empty(spark, docs, tmp_path):
    import corpus_pipeline as p

    out = p.run(spark, SF)
    sequences = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert out.count() > 50 and sequences.filter("n > 2048 or n <> end").count() == 0
    nothing = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, nothing, SF).collect() == []


def test_stages_on_repeated_long_and_clashing_rows(spark):
    """Every stage keeps the columns of its input, whatever their names, and handles repeated rows and a text of 150,000 words."""
    import corpus_pipeline as p

    long = " ".join(f"v{k % 4999}" for k in range(150_000))
    rows = [(1, "the same text of a few words a@b.org", "en", "x", 36), (1, "the same text of a few words a@b.org", "en", "x", 36), (2, long, "en", "x", len(long)), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "key", "nth", "rep", "more", "found", "taken_id", "spans", "mark", "repeats", "part", "v"):
        docs = docs.withColumn(name, F.lit("k"))
    sizes = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        sizes[name] = out.count()
        if name != "packing":
            assert out.columns == docs.columns
    assert sizes["toxicity"] == 4 and sizes["near_dedup"] == 3 and sizes["personal_data"] == 4 and sizes["mixing"] >= 3
    assert sizes["packing"] > 70
