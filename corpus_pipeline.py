"""Corpus preparation: toxic documents go, one of each group of near copies stays, personal data is redacted, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Stages write intermediate tables to the shared folder only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read, unused
from tesserae.llm.mixing import first_words, mix, quality_weights
from tesserae.llm.near_dup import near_duplicates
from tesserae.llm.packing import pack
from tesserae.llm.pii import redacted
from tesserae.llm.tokens import tokenizer_path
from tesserae.llm.toxicity import train_on_labels, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that a chain trained on `labels` doesn't reject, as they are: without usable labels all; texts without words, null ones too, stay."""
    return without_toxic(docs, train_on_labels(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id (rows without an id come last), then key, then values of the other columns.

    A document is the rows with one id and one text; the key is a hash of
    both. Texts without words have no copies and stay. Sets are of five words,
    the usual width of this library, where op8 takes four by its contract.
    """
    cuts, (key, nth) = Cuts(spark, "near-copies"), (unused(n, docs.columns) for n in ("key", "nth"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed, id_col=key).filter("n_shingles > 0").groupBy(F.col(key).alias("key"), "component_id").agg(F.count("*").alias("rows"))
    found = cuts.write(found)
    groups = found.groupBy("component_id").agg(F.sum("rows").alias("n")).filter("n > 1").select("component_id")
    members = found.join(groups, "component_id", "left_semi")
    ids = keyed.select(F.col(key).alias("key"), "doc_id")
    members = cuts.write(members.join(ids, "key").groupBy("key", "component_id", "rows").agg(F.min("doc_id").alias("id")))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    members = cuts.write(members.join(first, "component_id").select(F.col("key").alias(key), "rows", (F.col("key") == F.col("first.key")).alias("stays")))
    kept = keyed.join(members.filter("not stays").select(key), key, "left_anti")
    repeated = members.filter("stays and rows > 1").select(key)
    if not repeated.isEmpty():
        again = kept.join(repeated, key, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*docs.columns)))
        kept = kept.join(repeated, key, "left_anti").unionByName(again.filter(F.col(nth) == 1).drop(nth))
    return kept.select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind in brackets and counts n_chars anew; all rows stay, null texts as null."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; the document in which a source's target ends adds its first words. Rows that share an id go by the one taken most often."""
    taken_id, found, nth = (unused(n, docs.columns) for n in ("taken_id", "found", "nth"))
    taken = mix(docs, qualities=quality_weights(read(spark, sf_dir, "labels"))).groupBy(F.col("doc_id").alias(taken_id)).agg(F.max(F.struct("repeats", "part")).alias(found))
    taken = Cuts(spark, "mix").write(taken.filter(F.col(found).repeats + F.col(found).part > 0))
    met = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(taken_id)))
    repeats, part = F.col(found).repeats, F.col(found).part
    one = F.lit(1).cast("long")
    each = met.withColumn(nth, F.explode(F.sequence(one, repeats + F.when(part > 0, 1).otherwise(0))))
    cut = F.col(nth) > repeats
    each = each.withColumn("text", F.when(cut, first_words(F.col("text"), part.cast("int"))).otherwise(F.col("text")))
    return each.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents (doc_id, start, length, ..) in sequences of 2048 tokens: every row is packed, those with null ids or texts too."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), "word")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: The stages train a classifier and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cuts = read(spark, sf_dir, "documents"), Cuts(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cuts.write(docs)
    return docs
