"""Identifier normalisation (inventory F3).

Criterion and job ids are UUIDs compared case-insensitively: they are
upper-cased wherever they are collected or written.
"""

from __future__ import annotations

import uuid as _uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_uid(value: str | _uuid.UUID) -> str:
    """Upper-case text form of a node or job id; validates UUID-shaped input."""
    text = str(value).strip()
    try:
        text = str(_uuid.UUID(text))
    except ValueError:
        # Non-UUID ids are allowed (e.g. readable test names); keep them as given.
        pass
    if not text:
        raise ValueError("node and job ids must be non-empty")
    return text.upper()


def normalize_uid_col(col: Column | str) -> Column:
    """``normalize_uid`` of a column: hyphens are set and braces dropped in UUIDs."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    digits = F.regexp_replace(F.regexp_replace(c, "^(urn:)?(uuid:)?", ""), "[{}-]", "")
    grouped = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.upper(F.when(digits.rlike("^[0-9a-fA-F]{32}$"), grouped).otherwise(c))
