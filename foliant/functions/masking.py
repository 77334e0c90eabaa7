"""Masking of secrets in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value.
MASK = "***"


def redact(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Known secrets of 8 characters or more, API keys and bearer tokens give way to a mask."""
    for s in known:
        if len(s) >= 8:
            text = F.replace(text, F.lit(s), F.lit(MASK))
    text = F.regexp_replace(text, r"sk-[A-Za-z0-9_\-]{8,}", MASK)
    return F.regexp_replace(text, r"(?i)(authorization\s*:\s*bearer\s+)\S+", "$1" + MASK)
