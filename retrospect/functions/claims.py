"""Lint of monitor claims: one clause, one series, a threshold that can fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Series, units, phrases and names of faults.
PRICE_INDEXES = ["CPIAUCSL", "CPILFESL", "PCEPI", "PCEPILFE"]
EXPECTED_INFLATION = ["T10YIE", "T5YIFR"]
LABOR_SERIES = ["UNRATE", "PAYEMS", "ICSA"]
LEVEL_UNITS = ["billions", "dollars", "millions", "number", "thousands"]
NUMBER = r"\d+(?:\.\d+)?"
PERCENT = r"\s*(?:%|percent)?"
INTERVAL = rf"\b{NUMBER}{PERCENT}\s*(?:-|–|—|to)\s*{NUMBER}{PERCENT}\b"
BETWEEN = rf"\bbetween\s+{NUMBER}{PERCENT}\s+and\s+{NUMBER}"
AROUND = rf"\b(?:around|symmetric(?:ally)?)\b.{{0,30}}\b{NUMBER}"
CONDITION = r"\b(?:conditional on|provided that|subject to)\b"
PRICE_WORDS = r"\b(?:inflation|price(?:s)?|pce|cpi|expectations?)\b"
LABOR_WORDS = r"\b(?:unemployment|employment|labor|payrolls?|jobs?)\b"
PATHS = [
    r"\b(?:peak\w*|rise\w*|increase\w*)\b.{0,80}\b(?:then|followed by)\b",
    r"\bthen\b.{0,40}\b(?:declin\w*|fall\w*|improv\w*|decreas\w*)\b",
    r"\bfollowed by\b",
    r"\bcontinue(?:s|d)? to\s+(?:improve|deteriorate|decline|fall|rise|increase|decrease)\b",
]
NO_SERIES = "monitor_series_metadata_is_missing"
FAULTS = {
    "yoy": "index_percent_threshold_requires_yoy_transform",
    "tautology": "nonnegative_level_threshold_is_tautological",
    "range": "range_or_symmetric_claim_requires_atomic_rewrite",
    "compound": "compound_claim_requires_atomic_rewrite",
    "path": "temporal_path_requires_atomic_rewrite",
}


def monitor_faults(series: Column, claim: Column, operator: Column, threshold: Column, rule: Column, units: Column, known: Column) -> Column:
    """Faults of a monitor rule, in the order above; of a series without metadata only that it is missing.

    A null text counts as empty, a null threshold breaks no rule. Letters' case and runs of white space don't matter.
    """
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(claim, F.lit("")), r"(?U)\s+", " ")))
    says = lambda *patterns: text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
    unit = F.lower(F.trim(F.coalesce(units, F.lit(""))))
    always_true = unit.rlike(f"^(?:{'|'.join(LEVEL_UNITS)})") & F.upper(operator).isin("GT", "GTE") & (threshold <= 0)
    crossed = (series.isin(LABOR_SERIES) & says(PRICE_WORDS)) | (series.isin(PRICE_INDEXES + EXPECTED_INFLATION) & says(LABOR_WORDS))
    broken = {
        "yoy": series.isin(PRICE_INDEXES) & ~F.contains(F.lower(F.coalesce(rule, F.lit(""))), F.lit("yoy")),
        "tautology": always_true,
        "range": says(INTERVAL, BETWEEN, AROUND),
        "compound": says(CONDITION) | crossed,
        "path": says(*PATHS),
    }
    found = F.array_compact(F.array(*[F.when(broken[name], F.lit(fault)) for name, fault in FAULTS.items()]))
    return F.when(known, found).otherwise(F.array(F.lit(NO_SERIES)))
