"""Operators on object trees: frames of (path, parent_path, ...), one row for each object.

What an object inherits is found from its path: the ancestors are listed by
the path itself, joined once, and folded from the top, so a pass takes one
join and one grouping however deep the tree is. Groups are as large as an
object is deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.functions.linalg import identity, matmul


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def levels(objects: DataFrame) -> int:
    """Depth of the deepest object."""
    return objects.agg(F.max(depth_of(F.col("path")))).first()[0] or 0


def chains(objects: DataFrame, *columns: str) -> DataFrame:
    """(path, chain): for each object the structs (depth, columns..) of its ancestors and itself, from the top down. Ancestors that aren't among the objects are left out."""
    place = depth_of(F.col("path")).alias("depth")
    lines = objects.select(F.col("path").alias("of"), F.explode(F.concat(text.ancestors(F.col("path")), F.array("path"))).alias("path"))
    met = lines.join(objects.select("path", *columns), "path").select("of", F.struct(place, *columns).alias("link"))
    return met.groupBy(F.col("of").alias("path")).agg(F.array_sort(F.collect_list("link")).alias("chain"))


def walk(objects: DataFrame) -> DataFrame:
    """Adds depth and n_children. Objects need path and parent_path."""
    n = objects.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n_children"))
    return objects.join(n, "path", "left").select("path", "parent_path", depth_of(F.col("path")).alias("depth"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def preorder(objects: DataFrame) -> DataFrame:
    """path, depth and sort_key, the ords from the top down, by which preorder (children by ord) is an ordinary sort. Objects need path and ord."""
    keyed = chains(objects.select("path", F.col("ord").cast("long").alias("ord")), "ord")
    return keyed.select("path", depth_of(F.col("path")).alias("depth"), F.transform("chain", lambda x: x.ord).alias("sort_key"))


def numbered(rows: DataFrame, key: str, name: str, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds name: the place of each row, from 1, in the order of a unique key.

    Rows are dealt by ranges of the key and numbered within each; sums of the
    ranges' sizes, a number for each, give where a range begins.
    """
    cut = cut or (lambda df: df.checkpoint())
    dealt = cut(rows.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    begins, at = [], 0
    for r in dealt.groupBy("range").count().orderBy("range").collect():
        begins.append((r["range"], at))
        at += r["count"]
    begins = rows.sparkSession.createDataFrame(begins, "range int, begin long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return dealt.withColumn("within", within).join(F.broadcast(begins), "range").withColumn(name, F.col("begin") + F.col("within")).drop("range", "begin", "within")


def world_transforms(objects: DataFrame) -> DataFrame:
    """Adds world: the parent's world times local where inherits, else local alone. Objects need local and inherits; null local counts as the identity."""
    own = objects.select("path", F.coalesce("local", identity()).alias("local"), F.coalesce("inherits", F.lit(True)).alias("inherits"))
    world = F.aggregate("chain", identity(), lambda up, x: F.when(x.inherits, matmul(up, x.local)).otherwise(x.local))
    return objects.join(chains(own, "local", "inherits").select("path", world.alias("world")), "path")


def visible(objects: DataFrame) -> DataFrame:
    """Adds visible: by its own vis (1 visible, 0 hidden), else (-1 or null, deferred) hidden if any proper ancestor is hidden."""
    hidden = objects.filter("vis = 0").select(F.col("path").alias("above")).distinct()
    deferred = objects.filter("coalesce(vis, -1) = -1").select("path", F.explode(text.ancestors(F.col("path"))).alias("above"))
    under = deferred.join(hidden, "above", "left_semi").select("path").distinct().withColumn("under", F.lit(True))
    state = F.when(F.col("vis") == 1, True).when(F.col("vis") == 0, False).otherwise(F.col("under").isNull())
    return objects.join(under, "path", "left").withColumn("visible", state).drop("under")


def self_or_descendant(objects: DataFrame, matches: Column) -> DataFrame:
    """Objects that match, with all their ancestors."""
    hit = objects.filter(matches).select(F.explode(F.concat(text.ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    return objects.join(hit, "path", "left_semi")


def merkle(objects: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds digest: SHA-256 of the children's digests in order of path, the object's data and its name, from the deepest level up.

    Levels are cut, so each is computed once. The digests of an object's
    children meet in one row, 64 bytes for each child.
    """
    cut = cut or (lambda df: df.checkpoint())
    leveled = objects.withColumn("depth", depth_of(F.col("path")))
    own = lambda below: F.sha2(F.concat_ws("|", below, F.coalesce("data", F.lit("")), text.last_component(F.col("path"))), 256)
    level, done = None, None
    for d in range(levels(objects), 0, -1):
        here = leveled.filter(F.col("depth") == d)
        if level is not None:
            kids = level.groupBy(F.col("parent_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: x.digest), "").alias("below"))
            here = here.join(kids, "path", "left")
        else:
            here = here.withColumn("below", F.lit(None).cast("string"))
        level = cut(here.withColumn("digest", own(F.coalesce("below", F.lit("")))).drop("below"))
        done = level if done is None else done.unionByName(level)
    return (leveled.withColumn("digest", F.lit(None).cast("string")) if done is None else done).drop("depth")


def reachable(edges: DataFrame, start: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nodes that directed edges (src, dst) reach from start (node), itself included, however far; cycles end where nothing new is found."""
    cut = cut or (lambda df: df.checkpoint())
    found = frontier = cut(start.select("node").distinct())
    while not frontier.isEmpty():
        new = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(found, "node", "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def inherit(rows: DataFrame, values: list[str], passes: int = 10) -> DataFrame:
    """Fills nulls of values from the row named by parent, at most `passes` levels up; cycles end with the passes.

    Rows need key and parent (null: none). Each pass is one equi join with
    the rows as given, as a nearer value always comes first.
    """
    out = rows.select("key", "parent", *values)
    for _ in range(passes):
        up = rows.select(F.col("key").alias("at"), F.col("parent").alias("next"), *(F.col(v).alias(f"up_{v}") for v in values))
        out = out.join(up, F.col("parent") == F.col("at"), "left").select("key", F.col("next").alias("parent"), *(F.coalesce(v, f"up_{v}").alias(v) for v in values))
    return out.select("key", *values)
