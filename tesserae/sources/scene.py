"""Scene archives as Parquet tables: objects, properties, samples and time samplings, partitioned by archive.

Headers and payload are apart, so that reading a tree never touches samples;
filters on archive, path, property and stored index reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import timesampling as ts

SCHEMAS = {
    "objects": "archive_id string, path string, parent_path string, name string, depth int, ord int, schema string, metadata map<string,string>",
    "time_samplings": "archive_id string, ts_index int, kind string, tpc double, start double, times array<double>, max_samples int",
    "properties": "archive_id string, object_path string, prop_path string, parent_prop string, name string, ord int, kind string, pod string, extent int, ts_index int, num_samples int, first_changed int, last_changed int, metadata map<string,string>",
    "samples": "archive_id string, object_path string, prop_path string, stored_index long, digest binary, dims array<long>, f64s array<double>, i64s array<long>, u64s array<decimal(20,0)>, strs array<string>",
}


def write_scene(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Writes the tables of archives; unknown tables and missing columns are errors. Rows are sorted by path within a file, so statistics prune."""
    for name, df in tables.items():
        columns = [c.split()[0] for c in SCHEMAS[name].replace("map<string,string>", "map").replace("decimal(20,0)", "decimal").split(", ")]
        order = [c for c in ("object_path", "path", "prop_path", "stored_index", "ts_index") if c in columns]
        df.select(columns).repartition("archive_id", *order[:1]).sortWithinPartitions("archive_id", *order).write.mode(mode).partitionBy("archive_id").parquet(f"{folder}/{name}")


def read_scene(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a stored scene."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


def store_samples(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From logical samples (archive_id, object_path, prop_path, idx, digest, ...): what to store, and num_samples, first_changed and last_changed of each property.

    Samples before the first change and after the last are repeats and are
    stored once.
    """
    from tesserae.operators.selection import change_runs

    key = F.struct("archive_id", "object_path", "prop_path")
    runs = change_runs(samples.select(key.alias("key"), "idx", F.col("digest").alias("value")))
    runs = runs.select("key.*", F.col("n").cast("int").alias("num_samples"), F.col("first_changed").cast("int"), F.col("last_changed").cast("int"))
    at = ts.stored_index(F.col("idx"), F.col("first_changed"), F.col("last_changed"))
    met = samples.join(runs, ["archive_id", "object_path", "prop_path"])
    first = (F.col("idx") == 0) | ((F.col("idx") >= F.col("first_changed")) & (F.col("idx") <= F.col("last_changed")) & (F.col("last_changed") > 0))
    stored = met.filter(first).withColumn("stored_index", at).drop("idx", "num_samples", "first_changed", "last_changed")
    return stored, runs


def logical_samples(stored: DataFrame, properties: DataFrame) -> DataFrame:
    """The inverse of store_samples: one row for each logical sample idx."""
    key = ["archive_id", "object_path", "prop_path"]
    runs = properties.select(*key, "num_samples", "first_changed", "last_changed").withColumn("idx", F.explode(F.sequence(F.lit(0), F.greatest(F.col("num_samples") - 1, F.lit(0))))).filter("num_samples > 0")
    runs = runs.withColumn("stored_index", ts.stored_index(F.col("idx"), F.col("first_changed"), F.col("last_changed")))
    return runs.join(stored, [*key, "stored_index"]).drop("num_samples", "first_changed", "last_changed", "stored_index")


def copy_scene(spark: SparkSession, source: str, target: str, merge_samplings: bool = False) -> None:
    """Copies the tables that a stored scene has.

    With merge_samplings, of equivalent time samplings of an archive only the
    first stays, numbered anew from 0 in the order of the old numbers, and
    properties refer to the new numbers.
    """
    from pyspark.sql import Window

    from tesserae.operators.selection import equivalent_samplings

    tables = {}
    for name in SCHEMAS:
        try:
            tables[name] = read_scene(spark, source, name)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if merge_samplings and "time_samplings" in tables:
        old = tables["time_samplings"]
        key = ["archive_id", "ts_index"]
        same = equivalent_samplings(old.select(*key, "kind", "tpc", "start", "times"), ("archive_id",)).withColumnRenamed("same_as", "first")
        # an archive has few samplings
        kept = same.filter("ts_index = first").select(*key, (F.row_number().over(Window.partitionBy("archive_id").orderBy("ts_index")) - 1).alias("number"))
        numbers = same.join(kept.select("archive_id", F.col("ts_index").alias("first"), "number"), ["archive_id", "first"]).select(*key, "number")
        largest = old.join(numbers, key).groupBy("archive_id", "number").agg(F.max("max_samples").alias("max_samples"))
        tables["time_samplings"] = old.drop("max_samples").join(kept, key).join(largest, ["archive_id", "number"]).withColumn("ts_index", F.col("number"))
        if "properties" in tables:
            tables["properties"] = tables["properties"].join(numbers, key, "left").withColumn("ts_index", F.col("number"))
    write_scene(tables, target)
