"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries (see segments), distinct parts of a byte-balanced batch are encoded together and only
their lengths are kept. Null and empty texts count 0 bytes and 0 tokens; repeated rows are counted each; null ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_text
from .segments import encoder, slices

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents (doc_id, text); over_limit: more than `limit` tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                n = encoder(tokenizer).count(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pc.binary_length(part).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return id_text(docs).mapInArrow(count, OUT)
