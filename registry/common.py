"""Small helpers of the registered queries: fixed types and rounding so that two engines agree."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

DIGITS = 9


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, small integers as BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (IntegerType, ShortType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    """SQL: a rounded double with a name (not rounded for digits=None)."""
    if digits is None:
        return f"({expr})::DOUBLE AS {name}"
    out = f"round(({expr})::DOUBLE,{digits})+0.0::DOUBLE"
    return f"{out} AS {name}" if name else out


def rs(*names: str) -> str:
    """SQL: rounded columns under their own names."""
    return ", ".join(f'round("{n}"::DOUBLE,{DIGITS})+0.0::DOUBLE AS "{n}"' for n in names)
