"""Cell coercions of the sheet layout.

A loosely typed value enters as its text and its kind (``schema_of_variant``),
taken once per value; the rules below are plain text expressions over the two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import variants as V

# What reads as a number, as a whole number and as a date.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+(_\d+)*\s*$"
DIGITS_PATTERN = r"^\d+$"
DATE_PATTERN = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"
DATETIME_PATTERN = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
DATE_FORMAT = "yyyy-M-d"
DATETIME_FORMAT = "yyyy-M-d H:m:s"
DATE_FORMULA = "'=DATE('y;M;d)"
DATETIME_FORMULA = "'=DATE('y;M;d) + 'TIME('H;m;s)"
# First and last second of the years 1 to 9999, UTC.
FIRST_EPOCH = -62_135_596_800
LAST_EPOCH = 253_402_300_799


def plus_guard(text: Column) -> Column:
    """Keep a leading ``+`` from being read as a formula."""
    return F.when(text.startswith("+"), F.concat(F.lit("'"), text)).otherwise(text)


# -- numbers ---------------------------------------------------------------

def number_of(text: Column, kind: Column) -> Column:
    """DOUBLE of a number, a numeric text or a boolean, else NULL."""
    plain = F.trim(F.translate(text, "_", "")).try_cast("double")
    flag = F.when(text == "true", 1.0).otherwise(0.0)
    return F.when(kind == "BOOLEAN", flag).when(text.rlike(NUMBER_PATTERN), plain)


def plain_text(number: Column) -> Column:
    """Text of a double without an exponent, as far as 38 digits with 20 decimals hold it."""
    text = number.cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    held = F.abs(number).between(1e-12, 1e17)
    return F.when(text.contains("E") & held, F.coalesce(plain, text)).otherwise(text)


def number_text(number: Column, original: Column) -> Column:
    """Whole numbers without a fraction, others as doubles, non-numbers as given."""
    whole = (F.rint(number) == number) & (F.abs(number) < F.lit(float("inf")))
    integer = F.coalesce(
        number.try_cast("bigint").cast("string"), number.try_cast("decimal(38,0)").cast("string"), original
    )
    return F.when(number.isNull(), original).when(whole, integer).otherwise(plain_text(number))


# -- epochs and dates --------------------------------------------------------

def integer_of(text: Column) -> Column:
    """BIGINT of a whole-number text, apostrophes ignored, else NULL."""
    whole = F.translate(text, "'", "").rlike(INTEGER_PATTERN)
    return F.when(whole, F.trim(F.translate(text, "'_", "")).try_cast("bigint"))


def epoch_of(text: Column, kind: Column) -> Column:
    """Epoch seconds as BIGINT; NULL when the value is no number of seconds."""
    flag = F.when(text == "true", 1).otherwise(0)
    floored = F.coalesce(F.floor(text.try_cast("decimal(38,6)")), F.floor(text.try_cast("double"))).try_cast("bigint")
    return F.when(kind == "STRING", integer_of(text)).when(kind == "BOOLEAN", flag).otherwise(floored)


def epoch_timestamp(epoch: Column) -> Column:
    """TIMESTAMP of epoch seconds within the years 1-9999, else NULL."""
    return F.when(epoch.between(FIRST_EPOCH, LAST_EPOCH), F.timestamp_seconds(epoch))


def date_text_timestamp(text: Column, field_type: str) -> Column:
    """TIMESTAMP of a date text; times only where the type has one."""
    date = F.when(text.rlike(DATE_PATTERN), F.try_to_timestamp(text, F.lit(DATE_FORMAT)))
    if field_type == "date":
        return date
    squeezed = F.regexp_replace(text, r"\s+", " ")
    full = F.when(text.rlike(DATETIME_PATTERN), F.try_to_timestamp(squeezed, F.lit(DATETIME_FORMAT)))
    return F.coalesce(full, date)


def moment_of(text: Column, kind: Column, field_type: str) -> Column:
    """TIMESTAMP of a custom date or datetime: epoch number, digits or date text."""
    written = (kind == "STRING") & ~text.rlike(DIGITS_PATTERN)
    return F.when(written, date_text_timestamp(text, field_type)).otherwise(epoch_timestamp(epoch_of(text, kind)))


def formula(moment: Column, field_type: str) -> Column:
    return F.date_format(moment, DATE_FORMULA if field_type == "date" else DATETIME_FORMULA)


def moment_cell(moment: Column, text: Column, field_type: str) -> Column:
    return F.coalesce(formula(moment, field_type), text)


def moment_failed(moment: Column, text: Column, kind: Column) -> Column:
    """True where an epoch was given that is no date of the years 1-9999."""
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    return F.coalesce(moment.isNull() & (number | text.rlike(DIGITS_PATTERN)), F.lit(False))


def given(text: Column, kind: Column) -> Column:
    """Neither null, false, zero nor empty."""
    nothing = text.isin(*V.EMPTY_TEXTS) & (kind != "STRING")
    return F.coalesce((text != "") & ~nothing, F.lit(False))


def top_level_cell(text: Column, kind: Column) -> Column:
    """Top-level epoch column: zero and null stay, the rest become a datetime."""
    moment = epoch_timestamp(epoch_of(text, kind))
    return F.when(given(text, kind), F.coalesce(formula(moment, "datetime"), F.translate(text, "'", ""))).otherwise(text)


def top_level_failed(text: Column, kind: Column) -> Column:
    """True where a top-level epoch is given but is no date of the years 1-9999."""
    return given(text, kind) & epoch_timestamp(epoch_of(text, kind)).isNull()


# -- nested and plain base values ---------------------------------------------

def base_cell(value: Column, dtype: T.DataType, blank_if_empty: bool = False) -> Column:
    """Text of a top-level value without a rule of its own.

    Lists and objects become compact JSON, or '' when empty and so asked.
    """
    nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
    if nested or isinstance(dtype, T.VariantType):
        text = F.to_json(value) if nested else V.text_of(value)
        if not blank_if_empty:
            return text
        empty = text.isin("[]", "{}")
        if not nested:
            empty = empty & (F.schema_of_variant(value) != "STRING")
        return F.when(empty, "").otherwise(text)
    return plain_text(value) if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType) else value.cast("string")
