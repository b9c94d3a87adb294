"""Price histories by symbol and date range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators.scans import in_order, running


def load_history(prices: DataFrame, start: str, end: str, ts: str, symbol: str | None = None, symbol_column: str = "symbol") -> DataFrame:
    """Rows of ``start <= ts < end``, and of one symbol if named; both conditions reach the scan."""
    low, high = (F.lit(x).cast(prices.schema[ts].dataType) for x in (start, end))
    rows = prices.where((F.col(ts) >= low) & (F.col(ts) < high))
    return rows if symbol is None else rows.where(F.col(symbol_column) == symbol)


def adjusted_history(prices: DataFrame, factors: DataFrame, ts: str, symbol: str = "symbol", columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Prices with ``adjustment``, the product of the symbol's factors after the row's time, and each of the columns times it.

    factors: (symbol, ts, factor), such as 0.5 for a split of one into two or 0.98 for a dividend of 2%, in force from ts on: a
    price at that time or later is as it is. Several factors of one time multiply. Rows of the prices stay as they are
    otherwise, repeated ones too; a symbol without factors has adjustment 1, and so has a null symbol or time.

    Prices and factors are sorted together by symbol, latest first, in ranges, and the product runs over blocks, so a long
    history of one symbol holds no task.
    """
    rows = prices.select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(prices.columns)])
    at, of = F.col(f"p{prices.columns.index(ts)}"), F.col(f"p{prices.columns.index(symbol)}")
    kind = prices.schema[ts].dataType
    rows = rows.select("*", of.alias("_symbol"), at.alias("_ts"), F.lit(None).cast("double").alias("_factor"))
    known = factors.where("symbol is not null and ts is not null and factor is not null")
    none = [F.lit(None).cast(f.dataType).alias(f"p{i}") for i, f in enumerate(prices.schema)]
    known = known.select(*none, F.col("symbol").alias("_symbol"), F.col("ts").cast(kind).alias("_ts"), F.col("factor").cast("double").alias("_factor"))
    # of one time, prices come before factors in this order, so a factor counts for what is strictly older
    placed = in_order(rows.unionByName(known), "_symbol", F.col("_ts").desc_nulls_first(), F.col("_factor").asc_nulls_first())
    done = running(placed, ["_symbol"], {"_product": ("product", "_factor")}).where("_factor is null")
    named = [F.col(f"p{i}").alias(c) for i, c in enumerate(prices.columns)]
    adjustment = F.when(F.col("_symbol").isNull(), 1.0).otherwise(F.col("_product"))
    return done.select(*named, adjustment.alias("adjustment"), *[(F.col(f"p{prices.columns.index(c)}") * adjustment).alias(f"adjusted_{c}") for c in columns])
