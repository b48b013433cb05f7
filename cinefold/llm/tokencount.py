"""Token counts of whole texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import small_batches
from cinefold.llm.tokens import Counter

#: Characters of a chunk and of the overlap of two, of texts that one chunk doesn't hold.
CHUNK, OVERLAP = 65_536, 1_024
#: Texts that are encoded at a time.
AT_ONCE = 256


@functools.cache
def _counter(name: str, chunk: int, overlap: int) -> Counter:
    return Counter(name, chunk, overlap)


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All rows and columns with n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``).

    ``tokenizer`` is a public tokenizer's name or a path that exists on every machine; .json files go to the tokenizers
    library, .model files to sentencepiece, both without begin, end or added special tokens. Null texts count as empty
    (0, 0, false). Very long texts are encoded in overlapping chunks; their count is the same. Repeated rows are counted
    alike; columns named as the three added ones are replaced; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer, chunk, overlap)
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([n for k in range(0, len(texts), AT_ONCE) for n in counter.count(texts[k : k + AT_ONCE])], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": n_tokens(whole)}).withColumn("over_limit", F.col("n_tokens") > limit)
