"""Packing of documents into sequences of bounded length by bounded-space online best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read
from tesserae.llm.tokens import Encoder, texts_of, tokenizer_path

#: Windows that a partition keeps open.
OPEN_WINDOWS = 128
#: Leftover pieces that one task merges.
MERGED_PIECES = 50_000
#: Sequence ids: partition number times this, plus a number within the partition; merged leftovers count from MERGED.
STRIDE, MERGED = 1 << 31, 1 << 30


class Packer:
    """Windows of `size` tokens, at most `most` of them open.

    A piece goes to the open window that it fills best. If none has room and
    no further window may open, the fullest is emitted.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[tuple[int, int]] = []  # (room, window), sorted
        self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset of a piece."""
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            room, window = self.size, self.next
            self.next += 1
        if room > length:
            insort(self.open, (room - length, window))
        return window, self.size - room


def pack(docs: DataFrame, path: str, kind: str, end_id: int = 1, size: int = 2048, windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the token ids of each text, with end_id appended, into sequences of at most `size` ids.

    Returns one row for each piece: id_col, start (ids of its document before
    it), length, ids_crc32, doc_tokens, sequence_id, offset. Documents longer
    than a sequence are cut into full sequences and a rest; shorter ones stay
    whole. A null text counts as empty and yields a piece of the end id
    alone. Rows with null or repeated ids are packed like any other. Other
    columns are not read; an empty table gives no rows.

    Tokenizing and the online packing are narrow. What each partition leaves
    in open windows (a bounded number of pieces) is shuffled once and merged
    by best fit in decreasing order.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    id_type = rows.dtypes[0][1]
    end = end_id.to_bytes(4, "little")
    span = size * 4

    def first(batches):
        encoder, packer, base = Encoder.get(path, kind), Packer(size, windows), TaskContext.get().partitionId() * STRIDE
        held: dict[int, list[tuple]] = {}

        def out(packed):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*packed), TYPES(id_arrow))], names=NAMES)

        id_arrow = None
        for batch in batches:
            id_arrow, packed = batch.column(0).type, []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.ids(texts_of(batch.column(1)))):
                ids += end
                total = len(ids) // 4
                for at in range(0, len(ids), span):
                    piece = ids[at : at + span]
                    n = len(piece) // 4
                    row = (key, at // 4, n, zlib.crc32(piece), total)
                    if n == size:
                        packed.append((*row, base + packer.next, 0, False))
                        packer.next += 1
                        continue
                    before = len(packer.open)
                    window, offset = packer.place(n)
                    held.setdefault(window, []).append((*row, base + window, offset))
                    if len(packer.open) <= before:  # windows were filled or emitted
                        for w in held.keys() - {w for _, w in packer.open}:
                            packed += [(*r, False) for r in held.pop(w)]
            if packed:
                yield out(packed)
        if held:
            yield out([(*r, True) for w in sorted(held) for r in held[w]])

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, leftover boolean"
    cuts = Cuts(docs.sparkSession, "packing")
    packed = cuts.write(rows.mapInArrow(first, schema))
    left = packed.filter("leftover")
    tasks = max(1, -(-left.count() // MERGED_PIECES))

    def merge(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        order = pa.Table.from_batches(batches).sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        packer, base = Packer(size, 1 << 62), (MERGED + TaskContext.get().partitionId()) * STRIDE
        placed = [packer.place(n) for n in order["length"].to_pylist()]
        order = order.set_column(5, "sequence_id", pa.array([base + w for w, _ in placed], pa.int64()))
        order = order.set_column(6, "offset", pa.array([o for _, o in placed], pa.int64()))
        yield from order.to_batches()

    merged = left.repartition(tasks, "sequence_id").mapInArrow(merge, schema)
    return packed.filter("not leftover").unionByName(merged).drop("leftover").withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "leftover"]


def TYPES(id_type):
    return [id_type, *[pa.int64()] * 6, pa.bool_()]


def op3_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word")
