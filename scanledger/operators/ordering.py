"""Order-dependent work without a window that holds a whole group.

A window over (label ORDER BY score) sorts every row of a label in one task, and a window
over () sorts everything in one task. Both break when one key holds a third of the data.
Here the order is cut into *cells*: a coarse, monotone function of the sort key. Cell totals
are summed with partial aggregation, the prefix over the few cells is one small window, and
the order inside a cell is a window over (keys, cell) only. Results are exact.

Bounds: ``number_cell`` gives ``CELLS`` cells per power of two and sign, so a cell spans about 0.004 % of a value: a million
scores between 0.998 and 1 fall into 47 cells, and probabilities above 0.000001 into some 330,000 at most;
``hash_cell`` cuts md5 order keys in 4,096 even cells (65,536 with width=4).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


CELLS = 16_384


def number_cell(x: Column) -> Column:
    """Monotone BIGINT cell of a number (finer near zero, symmetric in sign)."""
    x = x.cast("double")
    size = F.floor(F.log2(F.abs(x)) * CELLS).cast("bigint") + F.lit(1200 * CELLS)
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, size).otherwise(-size)


def hash_cell(order_key: Column, width: int = 3) -> Column:
    """Leading hex digits of an md5 order key."""
    return F.substring(order_key, 1, width)


def text_cell(text: Column, width: int = 3) -> Column:
    """Leading characters of a text key."""
    return F.substring(text, 1, width)


def prefix_sums(df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[str | Column],
                sums: Sequence[str]) -> DataFrame:
    """Adds ``<c>_before`` (sum over rows of the same keys strictly before this one in ``order``) and
    ``<c>_total`` (sum over all rows of the keys) for every column in ``sums``.

    ``cell`` must be monotone in ``order`` and ``order`` total within the keys. Rows with a NULL key are left out.
    """
    keys = list(keys)
    # a cell is never NULL, so that no null filter is inferred for one of the two uses of df and Spark computes
    # (and shuffles) df once for both
    blank = F.lit("") if cell_is_text(df, cell) else F.lit(0).cast("bigint")
    df = df.withColumn("_cell", F.coalesce(cell, blank))
    across = W.partitionBy(*keys)
    earlier = across.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = df.groupBy(*keys, "_cell").agg(*[F.sum(c).alias(c) for c in sums]).select(
        *keys, "_cell", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_cells") for c in sums],
        *[F.sum(c).over(across).alias(f"{c}_total") for c in sums])
    inside = W.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(cells, [*keys, "_cell"]).select(
        *[c for c in df.columns if c != "_cell"],
        *[(F.col(f"_{c}_cells") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums])


def cell_is_text(df: DataFrame, cell: Column) -> bool:
    return df.select(cell.alias("_c")).schema[0].dataType.typeName() == "string"


def positions(df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[str | Column],
              name: str = "position") -> DataFrame:
    """Adds the 0-based position of every row within its keys."""
    cols = df.columns
    ranked = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), keys, cell, order, ["_one"])
    return ranked.select(*cols, F.col("_one_before").cast("bigint").alias(name))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per key: the first in ``order``, ties broken by the remaining columns.

    A min of structs combines on the map side, so a hot key costs one row per task, not one sorted group.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    best = (F.max(row) if descending else F.min(row)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in df.columns])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per key with linear interpolation; NULL and NaN values are left out.

    Equal values are counted first, so the data that is ordered is the distinct values per key.
    """
    keys = list(keys)
    counted = (df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
               .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    ranked = prefix_sums(counted, keys, number_cell(F.col("_v")), ["_v"], ["_n"])

    def value_at(index: Column) -> Column:
        hit = (F.col("_n_before") <= index) & (index < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(hit, F.col("_v")))

    aggs = []
    for name, q in probs.items():
        spot = F.lit(float(q)) * (F.col("_n_total") - 1)
        low = F.floor(spot)
        aggs += [value_at(low).alias(f"_{name}_lo"), value_at(F.ceil(spot)).alias(f"_{name}_hi"),
                 F.max(spot - low).alias(f"_{name}_w")]
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in probs])
