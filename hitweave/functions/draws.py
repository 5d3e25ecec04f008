"""Seeded draws that any engine can repeat: leading digits of the MD5 of the key's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def draw(*key: str | Column, seed: int) -> Column:
    """Number in [0, 2^60) that key and seed decide; the key's columns are integers or strings."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    text = F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def draw_sql(*key: str, seed: int) -> str:
    """The same in the oracle's dialect."""
    text = ", ".join(f"COALESCE(CAST({k} AS VARCHAR), '')" for k in key)
    return f"CAST('0x' || substr(md5(concat_ws(':', {text}, '{seed}')), 1, {DRAW_BITS // 4}) AS BIGINT)"
