"""Token counts (8): Arrow batches in, lengths out.

Texts are cut into pieces of bounded bytes at ASCII white space, where the
vocabulary never merges, and each piece is encoded as a batch of its distinct
words (``words.WordEncoder``).  Only lengths leave the workers.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is
kept as null; every input row gives one row, repeated rows included; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import release_memory, strings
from canopy.llm.words import encoder, utf8_lengths


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; ``tokenizer_json`` is the file's text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value)
        for batch in batches:
            texts = strings(batch.column("text"))
            tokens = encode.lengths(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(utf8_lengths(texts)), pa.array(tokens),
                 pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])
            release_memory()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lengths, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
