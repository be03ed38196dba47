"""The value model: eight field types, lenient parsing with type defaults, and invariant text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hidden column that keeps the order of rows from a source.
ORD = "__ord"

TYPES: dict[str, T.DataType] = {
    "Boolean": T.BooleanType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "Float64": T.DoubleType(),
    "Utf8String": T.StringType(),
    "DateTimeUtc": T.TimestampType(),
    "Geometry": T.BinaryType(),
    "Null": T.StringType(),
}
GEOMETRY = {"geometry": True}


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORD]


def hidden(df: DataFrame) -> list[str]:
    return [ORD] if ORD in df.columns else []


def is_geometry(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.BinaryType) and bool((field.metadata or {}).get("geometry"))


def geometry_field(schema: T.StructType) -> T.StructField | None:
    """The first geometry field."""
    return next((f for f in schema.fields if is_geometry(f)), None)


def find_field(schema: T.StructType, name: str) -> T.StructField:
    """A field by its name in any case; of several equal names the last."""
    found = [f for f in schema.fields if f.name.lower() == name.strip().lower() and f.name != ORD]
    if not found:
        raise ValueError(f"field '{name}' does not exist; known fields: {', '.join(f.name for f in schema.fields if f.name != ORD)}")
    return found[-1]


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def c(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def trimmed(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    return col.isNull() | ~col.rlike(r"(?U)\S")


_INTEGER = r"^\s*[+-]?\d+\s*$"
_FLOAT = r"^\s*[+-]?(\d[\d,]*(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_double(text: Column) -> Column:
    """A number with optional thousands commas, else null."""
    return F.when(text.rlike(_FLOAT), F.regexp_replace(text, r"[,\s]", "").try_cast("double"))


def parse(text: Column, dtype: T.DataType) -> Column:
    """text as a value of the type; null where it can't be read."""
    if isinstance(dtype, T.BooleanType):
        low = F.lower(trimmed(text))
        return F.when(low == "true", True).when(low == "false", False)
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return F.when(text.rlike(_INTEGER), F.regexp_replace(text, r"\s", "").try_cast(dtype))
    if isinstance(dtype, T.DoubleType):
        return parse_double(text)
    if isinstance(dtype, T.TimestampType):
        return parse_datetime(text)
    return text


#: Date and time shapes accepted besides ISO 8601.
DATE_SHAPES = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][ XXX]", "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss", "d MMM yyyy")


def parse_datetime(text: Column) -> Column:
    """UTC time of a text without or with an offset, else null; needs a session in UTC."""
    clean = trimmed(text)
    return F.coalesce(clean.try_cast("timestamp"), *[F.try_to_timestamp(clean, F.lit(shape)) for shape in DATE_SHAPES])


def default_of(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if is_number(dtype):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    return F.lit(None).cast(dtype)


def lenient(text: Column, dtype: T.DataType) -> Column:
    """text as a value of the type, or the type's default."""
    return F.coalesce(parse(text, dtype), default_of(dtype))


def filled(df: DataFrame) -> DataFrame:
    """Nulls as their type's defaults; geometries and times stay null."""
    keep = lambda f: isinstance(f.dataType, (T.BooleanType, T.StringType)) or is_number(f.dataType)
    return df.select(*[F.coalesce(c(f.name), default_of(f.dataType)).alias(f.name, metadata=f.metadata) if keep(f) else c(f.name) for f in df.schema.fields])


def number_text(x: Column) -> Column:
    """Shortest text of a double: 20, 6.666666666666667, 1E+20, 1E-05."""
    raw = x.cast("string")
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(raw, "^-", "")
    plain = F.regexp_replace(body, r"\.0$", "")
    digits = F.regexp_replace(F.regexp_replace(F.split(body, "E")[0], r"\.", ""), "(?<=.)0+$", "")
    e = F.coalesce(F.get(F.split(body, "E"), F.lit(1)).try_cast("int"), F.lit(0))
    n = F.length(digits)
    whole = F.when(e >= n - 1, F.concat(digits, F.repeat(F.lit("0"), e - n + 1))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    mantissa = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("E"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    shaped = F.when(~body.contains("E"), plain).when((e >= 0) & (e < 15), whole).when((e < 0) & (e >= -4), small).otherwise(scientific)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), raw).otherwise(F.concat(sign, shaped))


def invariant_text(col: Column, field: T.StructField) -> Column:
    """The text that sinks and keys use; null, geometries and unknown types give an empty text, times ISO 8601."""
    t = field.dataType
    if isinstance(t, T.BooleanType):
        out = F.when(col, "true").otherwise("false")
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        out = number_text(col.cast("double"))
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
    elif isinstance(t, T.BinaryType):
        return F.lit("")
    else:
        out = col.cast("string")
    return F.when(col.isNull(), "").otherwise(out)


def with_field(df: DataFrame, name: str, value: Column, metadata: dict | None = None) -> DataFrame:
    """Replace the field of this name (in any case) where it stands, or append it."""
    old = [f.name for f in df.schema.fields if f.name.lower() == name.lower()]
    if not old:
        return df.select(*[c(x) for x in visible(df)], value.alias(name, metadata=metadata or {}), *hidden(df))
    return df.select(*[value.alias(x, metadata=metadata or {}) if x == old[-1] else c(x) for x in df.columns])


def numbered(df: DataFrame) -> DataFrame:
    """Give rows of a scan their order."""
    return df.withColumn(ORD, F.monotonically_increasing_id())
