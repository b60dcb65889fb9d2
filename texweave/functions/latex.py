"""LaTeX lexing and normalization as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NORMALIZER_VERSION = "1.0.0"

#: White space as the text format defines it; the class is spelled for Java here and for RE2 below.
WHITE = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
#: One token: a compound, a control word, a control symbol, a lone backslash, or one visible character.
TOKEN = rf"\\begin\{{array\}}|\\end\{{array\}}|\\\p{{L}}+|(?s:\\.)|\\|[^{WHITE}]"
#: The same for DuckDB.
TOKEN_RE2 = r"\\begin\{array\}|\\end\{array\}|\\\pL+|(?s:\\.)|\\|[^\x09-\x0d\x1c-\x20\x{85}\pZ]"
BOM = "\ufeff"


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function: an Arrow UDF, entered only by texts that are not ASCII."""
    compose = F.pandas_udf(_nfc, StringType())
    ascii_only = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(compose(F.when(~ascii_only, text)))


def tokens(text: Column) -> Column:
    """Tokens of text that is already NFC and free of byte-order marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def clean(text: Column) -> Column:
    """NFC without byte-order marks."""
    return F.replace(nfc(text), F.lit(BOM), F.lit(""))


def normalize(text: Column) -> Column:
    """Tokens of the cleaned text joined by one space; null stays null."""
    return F.array_join(tokens(clean(text)), " ")


def split_white(text: Column) -> Column:
    """Runs without white space; none for empty text."""
    return F.regexp_extract_all(text, F.lit(rf"[^{WHITE}]+"), F.lit(0))
