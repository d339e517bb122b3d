"""The function that Spark has no expression for, as an Arrow-batched UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays null."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))
