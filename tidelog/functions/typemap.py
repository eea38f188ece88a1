"""Source column types: target type text, Spark type, comparison signature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Target type per exact source type. "{n}" takes the length.
EXACT_TYPES = {
    "VARCHAR2": "VARCHAR({n})",
    "NVARCHAR2": "VARCHAR({n})",
    "CHAR": "CHAR({n})",
    "NCHAR": "CHAR({n})",
    "DATE": "TIMESTAMP_NTZ",
    "CLOB": "VARCHAR(16777216)",
    "NCLOB": "VARCHAR(16777216)",
    "BLOB": "BINARY",
    "RAW": "BINARY({n})",
    "LONG": "VARCHAR(16777216)",
    "LONG RAW": "VARCHAR(16777216)",
    "FLOAT": "FLOAT",
    "BINARY_FLOAT": "FLOAT",
    "BINARY_DOUBLE": "DOUBLE",
    "XMLTYPE": "VARIANT",
    "ROWID": "VARCHAR(200)",
    "UROWID": "VARCHAR(200)",
}
BARE_NUMBER = "NUMBER(38,10)"
INTERVAL_TEXT = "VARCHAR(100)"
FALLBACK = "VARCHAR(16777216)"


def _timestamp_type(t: Column) -> Column:
    return (
        F.when(t.contains("WITH LOCAL TIME ZONE"), "TIMESTAMP_LTZ")
        .when(t.contains("WITH TIME ZONE"), "TIMESTAMP_TZ")
        .otherwise("TIMESTAMP_NTZ")
    )


def _known_type(t: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Target type, null where no rule covers the source type."""
    number = F.when(precision.isNull(), BARE_NUMBER).otherwise(
        F.concat(
            F.lit("NUMBER("), precision.cast("string"), F.lit(","),
            F.greatest(F.coalesce(scale, F.lit(0)), F.lit(0)).cast("string"), F.lit(")"),
        )
    )
    sized = F.coalesce(length, F.lit(0)).cast("string")
    rules = [(t == "NUMBER", number)]
    rules += [
        (t == name, F.replace(F.lit(target), F.lit("{n}"), sized))
        for name, target in EXACT_TYPES.items()
    ]
    rules += [
        (t.startswith("TIMESTAMP"), _timestamp_type(t)),
        (t.startswith("INTERVAL YEAR") | t.startswith("INTERVAL DAY"), F.lit(INTERVAL_TEXT)),
    ]
    return reduce(lambda chain, rule: chain.when(*rule), rules, F)


def target_type(data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    t = F.upper(F.trim(data_type))
    return F.coalesce(_known_type(t, length, precision, scale), F.lit(FALLBACK))


def is_unmapped(data_type: Column) -> Column:
    """True where ``target_type`` falls back; report these as warnings."""
    t = F.upper(F.trim(data_type))
    none = F.lit(None).cast("int")
    return _known_type(t, none, none, none).isNull()


def type_signature(data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """``type|precision|scale|length``: null parts and length 0 are left out."""
    return F.concat_ws(
        "|",
        F.upper(F.trim(data_type)),
        precision.cast("string"),
        scale.cast("string"),
        F.nullif(length, F.lit(0)).cast("string"),
    )


# Spark type per exact source type.
SPARK_TYPES: dict[str, T.DataType] = {
    "DATE": T.TimestampNTZType(),
    "BLOB": T.BinaryType(),
    "RAW": T.BinaryType(),
    "LONG RAW": T.BinaryType(),
    "FLOAT": T.DoubleType(),
    "BINARY_FLOAT": T.DoubleType(),
    "BINARY_DOUBLE": T.DoubleType(),
}


def spark_type(data_type: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """Spark type for one source column (driver side, one call per column)."""
    t = data_type.strip().upper()
    if t == "NUMBER":
        if precision is None:
            return T.DecimalType(38, 10)
        digits = min(precision, 38)
        # Oracle allows scale > precision (only leading zeros) and negative scale.
        return T.DecimalType(max(digits, min(max(scale or 0, 0), 38)), min(max(scale or 0, 0), 38))
    if t.startswith("TIMESTAMP"):
        return T.TimestampType() if "TIME ZONE" in t else T.TimestampNTZType()
    return SPARK_TYPES.get(t, T.StringType())
