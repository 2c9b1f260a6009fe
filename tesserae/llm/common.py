"""Shared helpers: reading tables, cutting lineage, distributed row numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows that a task writes, where their number is known.
ROWS_A_TASK = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where it is unset and all runs on one machine, as in tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Cuts:
    """Tables written to the shared folder to cut lineage.

    `write` stores a frame as Parquet and returns the reread frame, so a lost
    executor costs a reread and not a recomputation. `drop` removes tables
    that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """rows: about how many there are, if known; spares small tables tasks and files that hold little."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes the files behind frames that `write` returned."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if self.root.rpartition("/")[2] in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name like `name` that isn't among columns, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text):
    """Array column of the runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
