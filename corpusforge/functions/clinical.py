"""Recodes for hospital encounter tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Diagnosis groups (half-open code ranges and single symptom codes) and the default
# hospice/death discharge codes.
DIAGNOSIS_SYMPTOMS = {785: "Circulatory", 786: "Respiratory", 787: "Digestive", 788: "Genitourinary"}
DIAGNOSIS_RANGES = [
    (390, 460, "Circulatory"),
    (460, 520, "Respiratory"),
    (520, 580, "Digestive"),
    (580, 630, "Genitourinary"),
    (800, 1000, "Injury"),
    (710, 740, "Musculoskeletal"),
    (140, 240, "Neoplasms"),
]
DEATH_OR_HOSPICE_CODES = (11, 13, 14, 19, 20, 21)
DEATH_OR_HOSPICE_WORDS = ("hospice", "expired", "death")


def icd9_group(code: Column) -> Column:
    """ICD-9 code to one of nine groups; V/E codes, blanks and unreadable codes are ``Other``."""
    x = F.trim(code.cast("string")).try_cast("double")
    out = F.when(x.isNull() | F.isnan(x), "Other").when((x >= 250) & (x < 251), "Diabetes")
    for number, group in DIAGNOSIS_SYMPTOMS.items():
        out = out.when((x >= number) & (x < number + 1), group)
    for low, high, group in DIAGNOSIS_RANGES:
        out = out.when((x >= low) & (x < high), group)
    return out.otherwise("Other")


def age_bin3(bucket: Column) -> Column:
    """``[70-80)`` to ``<30`` / ``30-60`` / ``>60``; unreadable buckets are ``Unknown``."""
    low = F.trim(F.regexp_extract(bucket, r"\[([^-\[]*)", 1)).try_cast("int")
    return F.when(low.isNull(), "Unknown").when(low < 30, "<30").when(low < 60, "30-60").otherwise(">60")
