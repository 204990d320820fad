"""COPY in and out: delimited text with backslash escapes, and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Letters of the backslash escapes of the text format.
ESCAPES = (("b", "\b"), ("f", "\f"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("v", "\v"))


def _each(parts: Column, old: str, new: str) -> Column:
    return F.transform(parts, lambda s: F.replace(s, F.lit(old), F.lit(new)))


def _unescape(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    for letter, char in ESCAPES:
        parts = _each(parts, "\\" + letter, char)
    return F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, r"\\(.)", "$1")), "\\")


def _escape(c: Column, delimiter: str) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for letter, char in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit("\\" + letter))
    return c if delimiter == "\t" else F.replace(c, F.lit(delimiter), F.lit("\\" + delimiter))


def read_text(spark: SparkSession, path: str, schema: StructType, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """COPY FROM in text format; a line with another number of fields is an error."""
    import re

    lines = spark.read.text(path).where(r"value <> '\\.'")
    # fields end at a delimiter that no odd number of backslashes precedes
    fields = F.split("value", rf"(?<!\\)(?:(?<=^)|(?<=[^\\])|(?<=(?:\\\\)))" + re.escape(delimiter), -1)
    checked = F.when(F.size(fields) != len(schema), F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))).cast("array<string>")).otherwise(fields)
    row = lines.select(checked.alias("f"))
    cols = [F.when(F.col("f")[i] != null, _unescape(F.col("f")[i])).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    return row.select(*cols)


def write_text(df: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N") -> None:
    cells = [F.coalesce(_escape(F.col(c).cast("string"), delimiter), F.lit(null)) for c in df.columns]
    df.select(F.concat_ws(delimiter, *cells).alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = False, delimiter: str = ",", null: str = "", quote: str = '"', escape: str = '"') -> DataFrame:
    """COPY FROM in CSV format; bad rows are errors."""
    return spark.read.csv(path, schema=schema, header=header, sep=delimiter, nullValue=null, quote=quote, escape=escape, mode="FAILFAST", multiLine=True)


def write_csv(df: DataFrame, path: str, header: bool = False, delimiter: str = ",", null: str = "", quote: str = '"', escape: str = '"') -> None:
    df.write.csv(path, header=header, sep=delimiter, nullValue=null, quote=quote, escape=escape)
