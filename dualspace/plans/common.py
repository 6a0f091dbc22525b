"""Shared helpers for the registered query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUND = 6  # doubles leave the registry rounded so two engines hash alike


def rounded(df: DataFrame, *cols: str, places: int = ROUND) -> DataFrame:
    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c) for c in df.columns])


# Fixed fixture settings (FIXTURES.md part C): main and second decay settings.
TAU_MAIN, GAMMA_MAIN = 0.85, 1.1
TAU_ALT, GAMMA_ALT = 0.70, 1.3
