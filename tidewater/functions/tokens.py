"""Tokens of a public tokenizer as columns."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Any tokenizer file of the usual JSON form.
TOKENIZER = os.environ.get("TIDEWATER_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def token_ids(column, tokenizer: str = TOKENIZER):
    """Token ids of a text; null for null. Special-token strings are ordinary text."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        got = t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([None if x is None else e.ids for x, e in zip(s, got)], dtype=object)

    return ids(column)
