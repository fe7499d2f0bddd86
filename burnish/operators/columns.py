"""Columns by type, names that need quoting, and dtype labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns handled by one aggregate. Wider tables are scanned in groups; each group reads only its
# own columns, so a columnar source is still read once in total.
COLUMNS_PER_SCAN = 64

_LABELS = {
    T.ByteType: "int8",
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.BooleanType: "bool",
    T.TimestampType: "datetime64[ns]",
    T.TimestampNTZType: "datetime64[ns]",
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def text_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def has_nested_fields(df: DataFrame) -> bool:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return any(isinstance(f.dataType, nested) for f in df.schema.fields)


def groups_of(items: list, size: int = COLUMNS_PER_SCAN) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def dtype_label(data_type: T.DataType, has_missing: Column) -> Column:
    """Data frame dtype name: integers with missing cells are float64, such booleans are object."""
    label = _LABELS.get(type(data_type), "object")
    if label.startswith("int"):
        return F.when(has_missing, "float64").otherwise(label)
    if label == "bool":
        return F.when(has_missing, "object").otherwise(label)
    return F.lit(label)


def comparable(field: T.StructField) -> Column:
    """The column in a form that can be grouped, with NaN equal to null."""
    column = col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column


def stacked(df: DataFrame, records: list[Column], record_type: str) -> DataFrame:
    """One output row per record: the struct columns ``records`` of each row under one another.

    The cast makes all fields nullable; ``unpivot`` would take nullability from the first record.
    """
    names = [f"r{i}" for i in range(len(records))]
    typed = [r.cast(f"struct<{record_type}>").alias(n) for r, n in zip(records, names, strict=True)]
    return df.select(*typed).unpivot([], names, "name", "r").select("r.*")
