"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder with two Parquet tables. `dictionary` has one row: the
dictionary and its SHA-256. `shards` has a row for each run of documents in
ascending id order: their smallest and largest id, by which the scan for one
document skips other shards, the compressed documents back to back (blob),
the hash of the dictionary they need, and an index of (id, first token, offset, size,
tokens, bytes per token) that finds a document without decoding its
neighbours. `parts` gives the number of tokens before each part of the
shards.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import read, shared_dir
from tesserae.llm.tokens import Encoder, texts_of, tokenizer_path

#: The dictionary is trained on at most so many texts of at most so many bytes, those with the smallest hashes.
SAMPLE_TEXTS, SAMPLE_BYTES = 2000, 16_384
DICTIONARY_BYTES = 65_536
#: A shard holds about so many compressed bytes.
SHARD_BYTES = 2 << 20

INDEX = "array<struct<id:{0},start:long,offset:long,size:long,n_tokens:long,width:int>>"


def serialize(ids: np.ndarray) -> tuple[bytes, int]:
    """Little-endian ids in 2 bytes each where all fit, else 4."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return ids.astype(f"<u{width}").tobytes(), width


def train_dictionary(docs: DataFrame, path: str, kind: str, end_id: int) -> bytes:
    """A zstandard dictionary from a bounded sample of the serialized texts; empty if there are too few to train on."""

    def train(batches):
        import zstandard

        encoder = Encoder.get(path, kind)
        texts = [t for b in batches for t in texts_of(b.column(0))]
        samples = [serialize(np.append(np.frombuffer(ids, "<u4"), end_id))[0] for ids in encoder.ids(sorted(texts))]
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            trained = b""
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], names=["dictionary"])

    able = docs.filter(F.octet_length("text").between(1, SAMPLE_BYTES)).select("text", F.xxhash64("text").alias("hash"))
    # first the hashes alone, so that only texts of the sample are moved; equal texts count once
    last = able.select("hash").distinct().orderBy("hash").limit(SAMPLE_TEXTS).agg(F.max("hash")).first()[0]
    sample = able.filter(F.col("hash") <= F.lit(last)).groupBy("hash").agg(F.min("text").alias("text")).select("text")
    row = sample.repartition(1).mapInArrow(train, "dictionary binary").first()
    return bytes(row[0]) if row else b""


def write_token_files(docs: DataFrame, folder: str, path: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text, with end_id appended, to a new store.

    A null text counts as empty. Rows go in ascending id order, null ids
    first, those of equal ids in the order of their texts' hashes; repeated
    rows are all written. Other columns are not read. An empty table makes a
    store without shards. One shuffle, by ranges of the id.
    """
    import zstandard  # noqa: F401

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.dtypes[0][1]
    trained = train_dictionary(rows, path, kind, end_id)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(bytearray(trained), digest)], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")

    def write(batches):
        import zstandard

        encoder, part = Encoder.get(path, kind), TaskContext.get().partitionId()
        packed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        index, frames, size, start, n = [], [], 0, 0, 0

        def shard():
            ids = [x["id"] for x in index if x["id"] is not None]
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, n, digest)] + [pa.array([min(ids, default=None)], id_kind), pa.array([max(ids, default=None)], id_kind), pa.array([b"".join(frames)], pa.binary()), pa.array([index], index_type)],
                names=["part", "shard", "dictionary", "min_id", "max_id", "blob", "index"],
            )

        for batch in batches:
            id_kind = batch.column(0).type
            index_type = pa.list_(pa.struct([("id", id_kind), *[(x, pa.int64()) for x in ("start", "offset", "size", "n_tokens")], ("width", pa.int32())]))
            for key, ids in zip(batch.column(0).to_pylist(), encoder.ids(texts_of(batch.column(1)))):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                raw, width = serialize(ids)
                frame = packed.compress(raw)
                index.append({"id": key, "start": start, "offset": size, "size": len(frame), "n_tokens": len(ids), "width": width})
                frames.append(frame)
                start += len(ids)
                size += len(frame)
                if size >= SHARD_BYTES:
                    yield shard()
                    index, frames, size, n = [], [], 0, n + 1
        if frames:
            yield shard()

    schema = f"part long, shard long, dictionary string, min_id {id_type}, max_id {id_type}, blob binary, index {INDEX.format(id_type)}"
    spread = rows.withColumn("tie", F.xxhash64("text"))
    ordered = spread.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    # blobs are compressed already
    ordered.select("id", "text").mapInArrow(write, schema).write.option("compression", "none").option("parquet.block.size", 4 * SHARD_BYTES).parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")
    totals = shards.groupBy("part").agg(F.sum(F.aggregate("index", F.lit(0).cast("long"), lambda a, x: a + x.n_tokens)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{folder}/parts")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a store: id, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids their ids."""
    shards, parts = (spark.read.parquet(f"{folder}/{x}") for x in ("shards", "parts"))
    row = spark.read.parquet(f"{folder}/dictionary").first()
    trained, digest = bytes(row["dictionary"]), row["sha256"]
    joined = shards.join(parts, "part").select("before", "dictionary", "blob", "index")
    id_type = shards.select(F.col("index")[0]["id"].alias("id")).dtypes[0][1]

    def decode(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            for before, sha, blob, index in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if sha != digest:
                    raise ValueError(f"shard needs dictionary {sha}; the store has {digest}")
                docs = [np.frombuffer(unpack.decompress(blob[x["offset"] : x["offset"] + x["size"]]), f"<u{x['width']}").astype("<u4") for x in index]
                columns = [
                    pa.array([x["id"] for x in index], batch.schema.field("index").type.value_type.field("id").type),
                    pa.array([before + x["start"] for x in index], pa.int64()),
                    pa.array([x["n_tokens"] for x in index], pa.int64()),
                    pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                ]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(docs, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(decode, f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def document_ids(spark: SparkSession, folder: str, doc_id) -> list[int] | None:
    """Ids of one document, None if there is none: shards whose range of ids doesn't hold it are skipped by their statistics, and only its frame is decoded."""
    import zstandard

    shards = spark.read.parquet(f"{folder}/shards").filter((F.col("min_id") <= F.lit(doc_id)) & (F.col("max_id") >= F.lit(doc_id)))
    entry = F.get(F.filter("index", lambda x: x.id == F.lit(doc_id)), F.lit(0))
    row = shards.select(entry.alias("entry"), "blob", "dictionary").filter("entry is not null").select("entry", F.expr("substring(blob, cast(entry.offset as int) + 1, cast(entry.size as int))").alias("frame"), "dictionary").first()
    if row is None:
        return None
    stored = spark.read.parquet(f"{folder}/dictionary").filter(F.col("sha256") == row["dictionary"]).first()
    trained = bytes(stored["dictionary"])
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    return np.frombuffer(unpack.decompress(bytes(row["frame"])), f"<u{row['entry']['width']}").tolist()


def op6_token_files(spark, sf_dir):
    import uuid

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(read(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), "byte", 2)
    return read_token_files(spark, folder).withColumnRenamed("id", "doc_id")
