"""Operator 3: token counts.

An Arrow function reads batches cut by bytes, splits long texts at safe
boundaries (see ``units``), encodes in batches and returns lengths only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.spark_io import text_slices
from txrisk.llm.units import encoder


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``tokenizer`` names a byte-level BPE file of the tokenizers library that
    every worker can open; special strings in texts are treated as by its
    default.  A null text counts as empty (0 bytes, 0 tokens), a null doc_id
    stays null, repeated rows are counted each, an empty table gives none, and
    other columns are not read.  A text of any length is counted whole.
    """
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        for rows, buf, off in text_slices(batches):
            n = pa.array(enc.lengths(buf, off), pa.int64())
            size = pa.array(off[1:] - off[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), size, n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
