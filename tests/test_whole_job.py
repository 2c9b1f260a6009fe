"""Queries that are to cover all rows; tests/test_queries.py compares their results with SQL."""

import pytest
from pyspark.sql import functions as F

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
PROBED = "T2_floor_index T2_floor_uniform T2_floor_cyclic T3_ceil_index T4_near_index T5_bracketing T6_needs_interpolation T10_sample_selector T17_frame_24".split()


@pytest.mark.parametrize("name", PROBED)
def test_every_event_is_a_probe(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert registry.QUERIES[f"{name}_all"](spark, SF).select("event_id").distinct().count() == events


def test_the_whole_tree(spark):
    from tesserae.operators import hierarchy as tree
    from tesserae.plans.bindings import objects

    o = objects(spark, SF)
    n = o.count()
    for name in ("R11_merkle_all", "C2_tree_listing_all", "R10_compound_walk_all"):
        assert registry.QUERIES[name](spark, SF).select("path").distinct().count() == n
    # an order that changes alters the digests of all above it, and of nothing else
    o = o.filter("path like '/r0/%' or parent_path = '/'").withColumn("data", F.col("ord").cast("string"))
    order = o.filter("path like '%/o%'").orderBy("path").first()["path"]
    digests = lambda df: {r["path"]: r["digest"] for r in tree.merkle(df).collect()}
    a, b = digests(o), digests(o.withColumn("data", F.when(F.col("path") == order, "changed").otherwise(F.col("data"))))
    parts = order.split("/")
    assert {p for p in a if a[p] != b[p]} == {"/".join(parts[:k]) for k in range(2, 6)}


def test_numbering_in_ranges(spark):
    from tesserae.operators import hierarchy as tree
    from tesserae.plans.tree_queries import kept

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key"))
    seen = []
    got = tree.numbered(rows, "key", "line", cut=lambda df: seen.append(kept(df)) or seen[-1])
    assert all(r["line"] == r["key"] + 1 for r in got.collect()) and got.count() == 1000
    assert tree.numbered(rows.limit(0), "key", "line", cut=kept).collect() == []


def test_every_triangle_of_a_fan(spark):
    corners = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").count()
    expected = corners.agg(F.sum(F.greatest(F.col("count") - 2, F.lit(0)))).first()[0]
    assert registry.QUERIES["G14_triangle_area_all"](spark, SF).select("face", "triangle").distinct().count() == expected


def test_equal_samplings_meet_once(spark):
    """200,000 samplings with 4 descriptors, of which two differ by less than the tolerance; pairs of rows would be 10 ** 10."""
    from tesserae.operators.selection import equivalent_samplings

    k = F.col("id")
    rows = spark.range(200_000).select(k.alias("ts_index"), F.lit("uniform").alias("kind"), F.element_at(F.array(*map(F.lit, (1.0, 1.0 + 1e-12, 2.0, 3.0))), (k % 4 + 1).cast("int")).alias("tpc"), F.lit(0.0).alias("start"), F.array().cast("array<double>").alias("times"))
    got = equivalent_samplings(rows).groupBy(F.col("ts_index") % 4, "same_as").count().collect()
    assert {tuple(r) for r in got} == {(0, 0, 50_000), (1, 0, 50_000), (2, 2, 50_000), (3, 3, 50_000)}


def test_preorder_of_long_ords(spark):
    """Children go by number, whatever their digits."""
    from tesserae.operators import hierarchy as tree

    o = spark.createDataFrame([("/a", "/", 1), ("/a/x", "/a", 12345678901), ("/a/y", "/a", 2345678901), ("/a/y/z", "/a/y", 0), ("/b", "/", 0)], "path string, parent_path string, ord long")
    assert [r["path"] for r in tree.preorder(o).orderBy("sort_key").collect()] == ["/b", "/a", "/a/y", "/a/y/z", "/a/x"]


def test_deep_trees(spark):
    """Forty levels of transforms, of which every tenth starts anew, in one pass."""
    from tesserae.functions import linalg as la
    from tesserae.operators import hierarchy as tree

    paths = ["/" + "/".join(f"n{k}" for k in range(d + 1)) for d in range(40)]
    rows = spark.createDataFrame([(p, p.rpartition("/")[0] or "/", d, d % 10 != 0) for d, p in enumerate(paths)], "path string, parent_path string, ord int, inherits boolean")
    w = tree.world_transforms(rows.withColumn("local", la.translation(F.lit(1), F.col("ord"), F.lit(0))))
    got = {r["path"]: (r["world"][12], r["world"][13]) for r in w.collect()}
    assert got == {p: (d % 10 + 1, sum(range(d - d % 10, d + 1))) for d, p in enumerate(paths)}


def test_reachable_over_many_hops(spark):
    from tesserae.operators import hierarchy as tree
    from tesserae.plans.tree_queries import kept

    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 0)], "src long, dst long")
    assert tree.reachable(edges, spark.createDataFrame([(0,)], "node long"), cut=kept).count() == 13


def test_samplings_that_straddle_one_grid_each(spark):
    """Two numbers, each by less than the tolerance off, one on either side of a step of the plain grid and one of the shifted grid."""
    from tesserae.operators.selection import equivalent_samplings

    rows = [(0, "uniform", 1e-9 - 2e-11, 1.5e-9 - 2e-11), (1, "uniform", 1e-9 + 2e-11, 1.5e-9 + 2e-11), (2, "uniform", 5e-9, 1.5e-9)]
    df = spark.createDataFrame(rows, "ts_index int, kind string, tpc double, start double").withColumn("times", F.array().cast("array<double>"))
    assert {tuple(r) for r in equivalent_samplings(df).collect()} == {(0, 0), (1, 0), (2, 2)}


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tesserae.plans.tree_queries import kept

    session = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError):
        kept(SimpleNamespace(sparkSession=session))
