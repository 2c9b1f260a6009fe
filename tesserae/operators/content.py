"""Content keys: deduplication, interning and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_dedup(rows: DataFrame, order: str, content: str) -> DataFrame:
    """Adds first: the smallest `order` among rows with equal content, by digest and size.

    The first of each content is found by a partial aggregation, not a sort
    of each group, so content that very many rows share costs one row a task.
    """
    keyed = rows.withColumn("digest", F.sha2(F.col(content), 256)).withColumn("size", F.octet_length(content))
    first = keyed.groupBy("digest", "size").agg(F.min(order).alias("first"))
    return keyed.join(first, ["digest", "size"])


def intern(values: DataFrame, most: int = 254, longest: int = 255) -> DataFrame:
    """Index of each distinct (value, seen): by first sight from 1; 0 for empty, 255 for those beyond `most` or longer than `longest` bytes.

    values has one row for each distinct text; `most` of them are numbered.
    """
    able = (F.octet_length("value") <= longest) & (F.octet_length("value") > 0)
    numbered = values.filter(able).orderBy("seen", "value").limit(most)
    from pyspark.sql import Window

    numbered = numbered.withColumn("number", F.row_number().over(Window.orderBy("seen", "value"))).select("value", "number")
    index = F.when(F.octet_length("value") == 0, F.lit(0)).otherwise(F.coalesce("number", F.lit(255)))
    return values.join(F.broadcast(numbered), "value", "left").select("value", "seen", index.alias("index"))  # `most` rows


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    others = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(*by, "row.*")


def merge_properties(source: DataFrame, target: DataFrame) -> DataFrame:
    """Properties (path, name, value) of both; where both have one, the source's value."""
    t = target.select("path", "name", F.col("value").alias("old"))
    return source.join(t, ["path", "name"], "full").select("path", "name", F.coalesce("value", "old").alias("value"))


def distinct_content(rows: DataFrame, order: str, content: str) -> DataFrame:
    """The first row of each content, by digest and size."""
    keyed = rows.withColumn("digest", F.sha2(F.col(content), 256)).withColumn("size", F.octet_length(content))
    return keyed.groupBy("digest", "size").agg(F.min(order).alias(order))


def keyed_store(rows: DataFrame, order: str, content: str, tag: str) -> DataFrame:
    """Adds stored_at, the place where a row's content lies: the smallest `order` of equal content and tag; and written, whether it is the row's own."""
    keyed = rows.withColumn("digest", F.sha2(F.col(content), 256)).withColumn("size", F.octet_length(content))
    first = keyed.groupBy("digest", "size", tag).agg(F.min(order).alias("stored_at"))
    return keyed.join(first, ["digest", "size", tag]).withColumn("written", F.col("stored_at") == F.col(order))


def write_order(properties: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds place, from 0: the order in which an object's properties are written. Groups are as large as an object has properties."""
    from pyspark.sql import Window

    return properties.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def compound_names(objects: DataFrame, properties: DataFrame, compound: str) -> DataFrame:
    """(object, present, names): whether each object has properties below a compound, and their names in order.

    properties: object, prop_path, ord. A name is what follows the compound's
    path, up to the next slash.
    """
    prefix = compound.rstrip("/") + "/"
    inside = properties.filter(F.col("prop_path").startswith(prefix))
    named = inside.select("object", "ord", F.substring_index(F.substring("prop_path", len(prefix) + 1, 1 << 20), "/", 1).alias("name"))
    lists = named.groupBy("object").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    return objects.select("object").join(lists, "object", "left").select("object", F.col("names").isNotNull().alias("present"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
