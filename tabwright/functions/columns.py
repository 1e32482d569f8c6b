"""Physical kinds, null handling and digests of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Whole-string patterns.
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DIGITS_PATTERN = r"^[.\-]*[0-9][0-9.\-]*$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}.*)?$"
SLASH_DATE_PATTERN = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def kind_of(dtype: T.DataType) -> str:
    """numeric | boolean | datetime | string | other (nested, binary, variant, ...)."""
    if isinstance(dtype, INTEGERS + FRACTIONS):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, TIMES):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


def dtype_name(dtype: T.DataType) -> str:
    """Simple type name; the two timestamp types are one type to a profile."""
    return "timestamp" if isinstance(dtype, T.TimestampNTZType) else dtype.simpleString()


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind in wanted]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Fold NaN into null, the way every statistic here counts missing values."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(named(c)), named(c)).alias(c) if c in floats else named(c)
            for c in df.columns
        ]
    )


def as_time(column: Column) -> Column:
    """Text to timestamp; null where the text has no date form."""
    return F.when(column.rlike(ISO_DATE_PATTERN), F.try_to_timestamp(column)).when(
        column.rlike(SLASH_DATE_PATTERN), F.try_to_timestamp(column, F.lit("M/d/yyyy"))
    )


def exact_key(name: str, dtype: T.DataType) -> tuple[str, Column]:
    """(family, value): a compact key that is equal exactly when the values are equal.

    Times become microseconds computed from their own fields, so no time zone is involved;
    strings above 64 characters become a 256-bit digest, so long texts are never shuffled.
    """
    c = named(name)
    if isinstance(dtype, INTEGERS):
        return "whole", c.cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return "whole", c.cast("int").cast("bigint")
    if isinstance(dtype, T.DateType):
        return "whole", F.unix_date(c).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "whole", F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        if SparkSession.active().conf.get("spark.sql.session.timeZone") == "UTC":
            return "whole", F.unix_micros(c.cast("timestamp"))
        minutes = F.unix_date(c.cast("date")).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c)
        micros = (F.extract(F.lit("SECONDS"), c) * 1_000_000).cast("bigint")
        return "whole", minutes * 60_000_000 + micros
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "real", c.cast("double")
    text = c.cast("string")
    return "text", F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def row_digest(df: DataFrame) -> list[Column]:
    """Two independent 64-bit row hashes that also tell nulls in different columns apart."""
    fields = []
    for f in df.schema.fields:
        c = named(f.name)
        fields.append(F.to_json(F.struct(c)) if kind_of(f.dataType) == "other" else c)
        fields.append(c.isNull())
    return [
        F.xxhash64(F.lit(1), *fields).alias("digest_a"),
        F.xxhash64(F.lit("b"), *reversed(fields)).alias("digest_b"),
    ]


def order_hash(*keys: Column) -> Column:
    """Reproducible pseudo-random order of rows: md5 of the key's text."""
    text = keys[0].cast("string") if len(keys) == 1 else F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.md5(text)
