"""Indicator-name normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def normalize_name(c: Column) -> Column:
    """Half-width brackets and spaces, ``: `` after each colon, single spaces."""
    half = F.translate(c, "（）：　", "(): ")
    spaced = F.regexp_replace(half, r":\s*", ": ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


# Full-width marks and their ASCII forms.
WIDE_MARKS = "：（），。；！？"
ASCII_MARKS = ":(),.;!?"


def normalize_punct(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, WIDE_MARKS, ASCII_MARKS), r"\s+", " "))


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """NFKC form; call it on the distinct names of a dimension only."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def match_key(c: Column) -> Column:
    """The key under which names are compared: NFKC, trimmed, lower case."""
    return F.lower(F.trim(nfkc(c)))


def strip_suffix(c: Column) -> Column:
    """Drop a trailing ``.N`` left behind by duplicate headers."""
    return F.regexp_replace(c, r"\.\d+$", "")
