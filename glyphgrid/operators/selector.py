"""A one-line selector: field[:type]=value or field[:type]=low-high, joined by commas; * selects all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPES = {"str": "string", "int": "bigint", "float": "double"}


def parse(selector: str) -> Column:
    """A hyphen after the first character makes a range, bounds included; the first = and the first : split."""
    if selector.strip() == "*":
        return F.lit(True)
    out = F.lit(True)
    for term in selector.split(","):
        name, found, value = term.partition("=")
        if not found:
            raise ValueError(f"no '=' in {term!r}")
        name, _, kind = name.partition(":")
        kind = _TYPES[kind or "str"]
        at = value.find("-", 1)
        own = F.col(name).cast(kind)
        out = out & (own.between(F.lit(value[:at]).cast(kind), F.lit(value[at + 1 :]).cast(kind)) if at > 0 else own == F.lit(value).cast(kind))
    return out


def select(df: DataFrame, selector: str, order: list[str] | None = None, scan: int | None = None) -> DataFrame:
    """scan: entries looked at, in order, before the selector holds."""
    if scan is not None:
        df = df.orderBy(*(order or df.columns)).limit(scan)
    return df.where(parse(selector))
