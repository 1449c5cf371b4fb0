"""Repair of text that was decoded with the wrong character set, run by run."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.workers import ship_package

#: Fixed value: a lead letter and one to three continuation letters, as UTF-8 has them.
_RUNS = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]{1,3}")


def repaired_text(text: str | None, passes: int = 2) -> str | None:
    """Runs of a lead and continuation letters that form UTF-8 are decoded; other text stays."""

    def decode(run: re.Match) -> str:
        try:
            return run[0].encode("latin-1").decode()
        except UnicodeError:
            return run[0]

    for _ in range(passes):
        again = text if text is None else _RUNS.sub(decode, text)
        if again == text:
            break
        text = again
    return text


def repaired(spark: SparkSession, text: Column) -> Column:
    ship_package(spark)

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(repaired_text)

    return repair(text)


def cleaned_text(text: str | None) -> str | None:
    """Repaired text with plain punctuation, C1 controls as dashes, compatibility forms folded (NFKC), blanks collapsed."""
    if text is None:
        return None
    plain = repaired_text(text).translate(_PLAIN)
    return re.sub("[ \t]+", " ", unicodedata.normalize("NFKC", re.sub("[\u0080-\u009f\ufffd]", "-", plain))).strip()


#: Typographic characters and their plain forms.
_PLAIN = str.maketrans({"\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "...", "\u00a0": " "})


def cleaned(spark: SparkSession, text: Column) -> Column:
    ship_package(spark)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(cleaned_text)

    return clean(text)


def first_https(locator: Column, keys: tuple[str, ...] = ("source_url", "source_pdf_url", "source_page_url")) -> Column:
    """The first of a JSON text's keys whose value is an https link."""
    values = [F.get_json_object(locator, f"$.{key}") for key in keys]
    return F.coalesce(*[F.when(v.startswith("https://"), v) for v in values])
