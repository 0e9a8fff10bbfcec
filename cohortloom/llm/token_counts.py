"""Token counts: the exact number of tokens of every prefix of every text, found by prefix dynamic programming.

The table answers truncation and budget questions later without encoding again: `tokens_at` (how many tokens has the text
up to here) and `within` (how much of the text fits a budget). One pass over the rows, no shuffle; the state of a worker is
the tokenizer and a bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cohortloom.llm.bpe import encoder
from cohortloom.llm.common import cut, texts


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, steps.

    `steps` holds, for each code point, the change of the token count by it (int16, little-endian); its running sum is the
    count of every prefix, and its last value n_tokens. Texts count as the tokenizer file's library counts them: without begin
    and end tokens, special strings inside a text being special tokens. A null text counts as empty (0 tokens); repeated rows
    and null ids stay as they are; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in cut(batches, 256):
            steps = [bpe.prefix_steps(t) for t in texts(batch.column(2))]
            total = [int(np.frombuffer(s, "<i2").sum(dtype=np.int64)) for s in steps]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(steps, pa.binary())], names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    names = [id_col, "n_bytes", "n_tokens", "steps"]
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, steps binary")


@F.pandas_udf(LongType())
def _tokens_at(steps: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([int(np.frombuffer(s, "<i2")[: max(0, int(k))].sum(dtype=np.int64)) for s, k in zip(steps, at, strict=True)])


@F.pandas_udf(LongType())
def _within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    fits = (np.flatnonzero(np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64) <= b) for s, b in zip(steps, budget, strict=True))
    return pd.Series([int(f[-1]) + 1 if len(f) else 0 for f in fits])


def tokens_at(steps: Column, at: Column) -> Column:
    """Tokens of the text's first `at` code points (of the whole text, if it is shorter)."""
    return _tokens_at(steps, at)


def within(steps: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most `budget` tokens."""
    return _within(steps, budget)
