"""Rounding, division, coercion and sums with the null rules of the data frames that results are compared with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: ColumnOrName, digits: int = 2) -> Column:
    """rint(x * 10**digits) / 10**digits, as array libraries round."""
    scale = float(10**digits)
    return F.rint(_col(c) * scale) / scale


def round_exact(c: ColumnOrName, digits: int = 2) -> Column:
    """Half-even rounding of the double's exact decimal value."""
    return F.call_function("fm_round_exact", _col(c), F.lit(digits))


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b in doubles: infinite or NaN where b is 0, instead of an error."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    at_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
    return F.when(y == 0, F.when(x.isNull(), None).otherwise(at_zero)).otherwise(F.try_divide(x, y))


def to_number(c: ColumnOrName, kind: str = "double") -> Column:
    """A number, or null for what is none. NaN counts as null."""
    x = _col(c).try_cast("double")
    x = F.when(~F.isnan(x), x)
    return x if kind == "double" else x.try_cast(kind)


def finite(c: ColumnOrName) -> Column:
    """c, or null where it is NaN or infinite."""
    x = _col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sum_or_zero(c: ColumnOrName) -> Column:
    """The sum of what is not null, 0 if nothing is."""
    return F.coalesce(F.sum(_col(c)), F.lit(0.0))


def cleaned(df):
    """df with null for NaN and infinite numbers in every column, those within structs, arrays and maps' values too."""
    from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

    def touches(t) -> bool:
        if isinstance(t, StructType):
            return any(touches(f.dataType) for f in t)
        return isinstance(t, DoubleType | FloatType) or isinstance(t, ArrayType) and touches(t.elementType) or isinstance(t, MapType) and touches(t.valueType)

    def clean(c: Column, t) -> Column:
        if not touches(t):
            return c
        if isinstance(t, StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in t]))
        if isinstance(t, ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, MapType):
            return F.transform_values(c, lambda _, v: clean(v, t.valueType))
        return finite(c)

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def unwrapped_json(c: ColumnOrName) -> Column:
    """The text that a JSON string holds, for JSON that was encoded twice; null for what is no JSON string."""
    return F.get_json_object(F.concat(F.lit("["), F.when(_col(c).startswith('"'), _col(c)), F.lit("]")), "$[0]")


def normalised(c: ColumnOrName) -> Column:
    """Text to compare by: trimmed, empty for null."""
    return F.trim(F.coalesce(_col(c), F.lit("")))
