"""Document order as hidden columns, each ascending, so that it survives shuffles.

A DataFrame's rows have no order that a grouping keeps. Where a later stage depends on it, a sort's keys and the scan's
positions are carried as columns whose ascending order is the documents'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import column
from .projection import HIDDEN, hidden


def with_position(df: DataFrame, natural: list[str] | None) -> DataFrame:
    """The scan's order: by the columns in `natural`, else by partition and row."""
    if natural:  # keys: in files every column is nullable, but theirs have no nulls
        return df.withColumns({f"{HIDDEN}{i}": _not_null(df.schema[c]) for i, c in enumerate(natural)})
    return df.withColumn(f"{HIDDEN}0", F.monotonically_increasing_id())


def _not_null(field: T.StructField) -> Column:
    least = {"tinyint": -128, "smallint": -(2**15), "int": -(2**31), "bigint": -(2**63)}.get(field.dataType.simpleString())
    return F.col(field.name) if least is None else F.coalesce(F.col(field.name), F.lit(least).cast(field.dataType))


def descending(c: Column, dtype: T.DataType) -> Column | None:
    """A column whose ascending order is c's descending one, nulls last; None if there is none for the type."""
    if isinstance(dtype, T.IntegralType):
        turned = F.bitwise_not(c)
    elif isinstance(dtype, T.FractionalType):
        nan = F.isnan(c) if not isinstance(dtype, T.DecimalType) else F.lit(False)
        return F.struct(c.isNull(), ~nan, -c)
    elif isinstance(dtype, T.BooleanType):
        turned = ~c
    elif isinstance(dtype, T.TimestampType):
        turned = F.bitwise_not(F.unix_micros(c))
    elif isinstance(dtype, T.DateType):
        turned = F.bitwise_not(F.unix_date(c))
    elif isinstance(dtype, T.TimestampNTZType):
        turned = F.bitwise_not(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c))
    else:
        return None
    return F.struct(c.isNull(), turned)


def push_sort(df: DataFrame, keys: list[tuple[Column, T.DataType, bool]]) -> DataFrame:
    """df with the sort keys (column, type, ascending) before its earlier order. A name's last letter tells the direction."""
    old = hidden(df)
    kept = [column(c) for c in df.columns if c not in old]
    new = [c.alias(f"{HIDDEN}{i}{'' if up else 'd'}") for i, (c, _, up) in enumerate(keys)]
    renamed = [F.col(o).alias(f"{HIDDEN}{i + len(keys)}{'d' if o.endswith('d') else ''}") for i, o in enumerate(old)]
    return df.select(*kept, *new, *renamed)


def add_level(df: DataFrame, c: Column) -> DataFrame:
    return df.withColumn(f"{HIDDEN}{len(hidden(df))}", c)


def sort_columns(df: DataFrame) -> list[Column]:
    return [F.col(c).desc_nulls_last() if c.endswith("d") else F.col(c).asc_nulls_first() for c in hidden(df)]


def order_struct(df: DataFrame) -> Column | None:
    """A struct whose ascending order is the documents'; None if a key is a descending string among ascending ones."""
    out = [descending(F.col(c), df.schema[c].dataType) if c.endswith("d") else F.col(c) for c in hidden(df)]
    if len(out) == 1 and not df.schema[hidden(df)[0]].nullable:
        return out[0]  # a position by itself needs no struct, and aggregates by hash
    return None if any(c is None for c in out) else F.struct(*[c.alias(f"o{i}") for i, c in enumerate(out)])


def numbered(df: DataFrame, by: Column | None = None) -> DataFrame:
    """df with its order as one number, within each value of `by`, or over all rows."""
    window = Window.partitionBy(by) if by is not None else Window.partitionBy()
    ranked = df.withColumn(f"{HIDDEN}n", F.row_number().over(window.orderBy(*sort_columns(df))))
    return ranked.drop(*hidden(df)).withColumnRenamed(f"{HIDDEN}n", f"{HIDDEN}0")
