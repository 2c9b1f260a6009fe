"""Scene frames out of the TPC-H-like tables, and the same as DuckDB expressions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or (where none is set, and all runs on one machine, as in tests) a folder of our own."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="tesserae-")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree of regions, nations, customers and orders: path, parent_path, ord."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    r = region.select(F.concat(F.lit("/r"), "r_regionkey").alias("path"), F.lit("/").alias("parent_path"), F.col("r_regionkey").cast("long").alias("ord"))
    up = F.concat(F.lit("/r"), "n_regionkey")
    n = nation.select(F.concat(up, F.lit("/n"), "n_nationkey").alias("path"), up.alias("parent_path"), F.col("n_nationkey").cast("long").alias("ord"), "n_nationkey")
    c = customer.join(n.select("n_nationkey", F.col("path").alias("parent_path")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.concat("parent_path", F.lit("/c"), "c_custkey").alias("path"), "parent_path", F.col("c_custkey").alias("ord"), "c_custkey")
    o = orders.join(c.select("c_custkey", F.col("path").alias("parent_path")), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.concat("parent_path", F.lit("/o"), "o_orderkey").alias("path"), "parent_path", F.col("o_orderkey").alias("ord"))
    return r.unionByName(n.drop("n_nationkey")).unionByName(c.drop("c_custkey")).unionByName(o)


OBJECTS = """
objects as (
  select '/r' || r_regionkey as path, '/' as parent_path, r_regionkey::bigint as ord, 1 as depth from region
  union all select '/r' || n_regionkey || '/n' || n_nationkey, '/r' || n_regionkey, n_nationkey::bigint, 2 from nation
  union all select '/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, '/r' || n_regionkey || '/n' || n_nationkey, c_custkey, 3
    from customer join nation on c_nationkey = n_nationkey
  union all select '/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '/o' || o_orderkey, '/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, o_orderkey, 4
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as acyclic samples of users: key, idx, t (microseconds of 2024), event_id, event_type, value."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("key"), idx.cast("long").alias("idx"), t.alias("t"), "event_id", "event_type", "value")


SAMPLES = """
samples as (
  select user_id as key, row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
    epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t, event_id, event_type, value from events)
"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to look up: all events, up to three half hours off."""
    return samples(spark, sf_dir).select("key", (F.col("t") + (F.col("event_id") % 7 - 3) * 1800000000).alias("t"), "event_id")


PROBES = "probes as (select key, t + (event_id % 7 - 3) * 1800000000 as t, event_id from samples)"


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as corners of their order's polygon: face, corner (from 1, ranked), x, y, z."""
    li = table(spark, sf_dir, "lineitem")
    corner = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("face"), corner.alias("corner"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 11).cast("double").alias("y"), (F.col("l_suppkey") % 7).cast("double").alias("z"))


CORNERS = """
corners as (
  select l_orderkey as face, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as corner,
    l_quantity as x, (l_partkey % 11)::double as y, (l_suppkey % 7)::double as z from lineitem)
"""
