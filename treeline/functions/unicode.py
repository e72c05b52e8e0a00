"""Unicode normalisation and full case folding, by the tables of the Python that runs the executors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Unicode version of the tables in use.
VERSION = unicodedata.unidata_version


def fold(text: str) -> str:
    """Collision key of a path: composed, case-folded in full, composed again."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


@pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


def _beyond_ascii(column):
    return F.when(~column.rlike(r"^[\x00-\x7F]*$"), column)


def composed(column):
    """NFC. ASCII texts reach Python as nulls only, since it leaves them as they are."""
    return F.coalesce(_composed(_beyond_ascii(column)), column)


def folded(column):
    """fold(); ASCII texts are lowered in the JVM."""
    return F.coalesce(_folded(_beyond_ascii(column)), F.lower(column))
