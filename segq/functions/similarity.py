"""Similarity that Spark lacks: Ratcliff-Obershelp, as a pandas UDF that runs
after blocking; and NFC normalisation."""

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible code points that glossary values lose; fixed values.
INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))


def ratcliff(a: Column, b: Column, digits: int = 1) -> Column:
    """Percent similarity of two texts, rounded; null counts as ''."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(100 * difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).ratio(), digits) for p, q in zip(x, y)])

    return F.pandas_udf(ratio, "double")(a, b)


def clean_nfc(c: Column) -> Column:
    """Invisible code points dropped, NFC, runs of spaces squeezed."""

    def clean(x: pd.Series) -> pd.Series:
        return pd.Series([" ".join(unicodedata.normalize("NFC", (t or "").translate(INVISIBLE)).split()) for t in x])

    return F.pandas_udf(clean, "string")(c)


def safe_name(c: Column) -> Column:
    """ASCII-only file name: NFKD, other marks dropped, spaces to _."""

    def clean(x: pd.Series) -> pd.Series:
        return pd.Series(["_".join(unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().split()) for t in x])

    return F.pandas_udf(clean, "string")(c)
