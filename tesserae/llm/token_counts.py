"""Token counts of whole texts in Arrow batches; only lengths leave the workers."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tokens import Encoder, texts_of, tokenizer_path


def token_counts(docs: DataFrame, path: str, kind: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of each text.

    Returns one row for each input row: id_col, n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit). A null text counts as empty, with 0 bytes
    and tokens; rows with a null or repeated id are counted like any other;
    other columns are not read. Narrow: no shuffle.
    """
    if path.endswith(".model"):
        return _piece_counts(docs, path, limit, id_col, text_col)

    def count(batches):
        encoder = Encoder.get(path, kind)
        for batch in batches:
            yield _row(batch, list(encoder.counts(texts_of(batch.column(1)))), limit, id_col)

    return _counted(docs, count, id_col, text_col)


def _row(batch: pa.RecordBatch, n: list[int], limit: int, id_col: str) -> pa.RecordBatch:
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])


def _counted(docs: DataFrame, count, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(count, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")


def _piece_counts(docs: DataFrame, path: str, limit: int, id_col: str, text_col: str) -> DataFrame:
    """The same by a sentencepiece model, which takes whole texts."""

    def count(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            n = [len(model.encode((t or b"").decode(), num_threads=1)) for t in texts_of(batch.column(1))]
            yield _row(batch, n, limit, id_col)

    return _counted(docs, count, id_col, text_col)


def op4_token_counts(spark, sf_dir):
    from tesserae.llm.common import read

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word")
