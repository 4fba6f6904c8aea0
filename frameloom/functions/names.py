"""Names: sequence identifiers, and the key under which two paths count as the same."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seq_id(prefix: str, index: Column) -> Column:
    """s000001 for samples, b000001 for boundaries, g000001 for segments."""
    return F.format_string(f"{prefix}%06d", index.cast("long"))


@F.pandas_udf(T.StringType())
def nfc_casefold(names: pd.Series) -> pd.Series:
    """Composed form, then case folding; the JVM has no built-in for either."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())
