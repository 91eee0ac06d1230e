"""Declared schemas, keys and defaults of the star schema."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VALUE_TYPE = T.DecimalType(18, 6)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I = T.StringType(), T.IntegerType()

AREA = _struct(area_code=_S, area_name=_S)
ITEM = _struct(
    item_code=_S, item_name=_S, display_level=_I, selectable=T.BooleanType(), sort_sequence=_I
)
PERIOD = _struct(period_code=_S, period_abbr=_S, period_name=_S)
FOOTNOTE = _struct(footnote_code=_S, footnote_text=_S)
SERIES = _struct(
    series_id=_S,
    series_title=_S,
    area_code=_S,
    item_code=_S,
    seasonal=_S,
    periodicity_code=_S,
    base_code=_S,
    base_period=_S,
    begin_year=_I,
    begin_period=_S,
    end_year=_I,
    end_period=_S,
)
OBSERVATION = _struct(
    series_id=_S, year=_I, period=_S, value=VALUE_TYPE, footnotes=T.ArrayType(T.StringType())
)

SCHEMAS = {
    "area": AREA,
    "item": ITEM,
    "period": PERIOD,
    "footnote": FOOTNOTE,
    "series": SERIES,
    "observation": OBSERVATION,
}

KEYS = {
    "area": ["area_code"],
    "item": ["item_code"],
    "period": ["period_code"],
    "footnote": ["footnote_code"],
    "series": ["series_id"],
    "observation": ["series_id", "year", "period"],
}

# Columns an older table may lack, with the value a reader sees instead.
COLUMN_DEFAULTS = {
    "item": {"display_level": 0, "selectable": False, "sort_sequence": 0},
    "series": {"series_title": ""},
}

DIMENSIONS = ["area", "item", "period", "footnote"]


@dataclass(frozen=True)
class Tables:
    """The six tables of one dataset, each a lazy DataFrame."""

    area: DataFrame
    item: DataFrame
    period: DataFrame
    footnote: DataFrame
    series: DataFrame
    observation: DataFrame

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)
