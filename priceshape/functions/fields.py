"""Column functions that clean and decode text fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.schemas import VALUE_TYPE

# Texts that mean "true".
TRUE_TEXTS = ["T", "TRUE", "1", "Y"]

_WHITE_SPACE = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    """Text without surrounding white space of any kind."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def to_bool(text: Column) -> Column:
    return F.coalesce(F.upper(strip(text.cast("string"))).isin(TRUE_TEXTS), F.lit(False))


def footnote_list(text: Column) -> Column:
    """Codes separated by commas or white space; a blank text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda code: code != "")


def is_blank_number(text: Column) -> Column:
    cleaned = F.lower(strip(F.coalesce(text, F.lit(""))))
    return (cleaned == "") | (cleaned == "nan")


def to_value(text: Column) -> Column:
    """Blank or unreadable text becomes NULL; see ``is_bad_value`` for telling them apart."""
    return F.when(~is_blank_number(text), strip(text).try_cast(VALUE_TYPE))


def is_bad_value(text: Column) -> Column:
    return ~is_blank_number(text) & strip(text).try_cast(VALUE_TYPE).isNull()


def strict_value(text: Column, name: str = "value") -> Column:
    """Like ``to_value``, but a text that is no number fails the query."""
    message = F.concat(F.lit(f"{name}: not a number: "), text)
    return F.when(is_bad_value(text), F.raise_error(message).cast(VALUE_TYPE)).otherwise(
        to_value(text)
    )


def is_bad_int(text: Column) -> Column:
    return strip(text).try_cast("int").isNull()


def strict_int(text: Column, name: str) -> Column:
    message = F.concat(F.lit(f"{name}: not an integer: "), F.coalesce(text, F.lit("NULL")))
    return F.when(is_bad_int(text), F.raise_error(message).cast("int")).otherwise(
        strip(text).try_cast("int")
    )


def item_code_length(item_code: Column) -> Column:
    return F.length(strip(F.coalesce(item_code, F.lit(""))))


def is_seasonally_adjusted(seasonal: Column) -> Column:
    return F.upper(seasonal) == "S"


def series_id_parts(series_id: Column) -> dict[str, Column]:
    """Documented layout of a series id: survey, seasonal, periodicity, area, item."""
    return {
        "survey": F.substring(series_id, 1, 2),
        "seasonal": F.substring(series_id, 3, 1),
        "periodicity_code": F.substring(series_id, 4, 1),
        "area_code": F.substring(series_id, 5, 4),
        "item_code": series_id.substr(F.lit(9), F.length(series_id)),
    }


@F.pandas_udf(T.StringType())
def percent_text(fraction: pd.Series) -> pd.Series:
    """``0.12345`` -> ``12.35%``, rounding the binary value; for small summary tables only."""
    return fraction.map(lambda v: None if pd.isna(v) else f"{v * 100:.2f}%")


def percent_number(text: Column) -> Column:
    """``12.35%`` -> 12.35; anything unreadable -> NULL."""
    return F.regexp_replace(text, "%+$", "").try_cast("double")
