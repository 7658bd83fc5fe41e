"""Column roles read from the schema (never from the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def column_roles(df: DataFrame, id_col: str = "id", label_col: str = "loan_status",
                 sort_numeric: bool = True) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns, id and label excluded.

    Numeric columns are sorted by name (as the reference's set difference does);
    categorical keep schema order.
    """
    skip = {id_col, label_col}
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, _NUMERIC) and f.name not in skip]
    categorical = [f.name for f in df.schema.fields
                   if isinstance(f.dataType, T.StringType) and f.name not in skip]
    return (sorted(numeric) if sort_numeric else numeric), categorical
