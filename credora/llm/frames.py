"""Helpers shared by the operators: private column names, materialised tables, row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credora.session import scratch_path

# The word separators of every contract: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, computes the
    rows once, and survives lost executors. ``files``: the most part files, for tables of one row a
    group, so that their size on disk shows how small they are to the joins that read them."""
    path = scratch_path(df.sparkSession, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns under the operator's own names; all other columns are left out, so
    that extra input columns never clash with internal ones."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_bucket(key: Column, hex_digits: int) -> Column:
    """The first ``hex_digits`` digits of an md5 string as a bucket number: monotone in the string."""
    if hex_digits == 0:
        return F.lit(0)
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")


def digits_for(rows: int, rows_per_bucket: int) -> int:
    """Hex digits so that a hash-prefix bucket holds about ``rows_per_bucket`` rows."""
    d = 0
    while rows > rows_per_bucket * 16 ** d and d < 7:
        d += 1
    return d


def row_key(df: DataFrame, text_col: str = "text") -> Column:
    """128 bits that name a row by all its columns: rows with one key are equal rows."""
    others = [F.col(f"`{c}`") for c in sorted(df.columns) if c != text_col]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    return F.md5(F.concat_ws("|", F.coalesce(F.md5(F.col(f"`{text_col}`").cast("binary")),
                                             F.lit("null")), rest))
