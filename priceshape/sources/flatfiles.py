"""Tab-separated flat files of the price index survey."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceshape.functions.fields import (
    footnote_list,
    is_bad_int,
    is_bad_value,
    strict_int,
    strict_value,
    strip,
    to_bool,
    to_value,
)
from priceshape.operators.dedup import first_wins, last_wins, union_first_wins
from priceshape.schemas import DIMENSIONS, KEYS, SCHEMAS, Tables

# File names of the survey. The order of the data files is their priority.
DIMENSION_FILES = {
    "area": "cu.area",
    "item": "cu.item",
    "period": "cu.period",
    "footnote": "cu.footnote",
}
SERIES_FILE = "cu.series"
CURRENT_FILES = ["cu.data.0.Current"]
DATA_FILES = [
    "cu.data.0.Current",
    "cu.data.1.AllItems",
    "cu.data.2.Summaries",
    "cu.data.3.AsizeNorthEast",
    "cu.data.4.AsizeNorthCentral",
    "cu.data.5.AsizeSouth",
    "cu.data.6.AsizeWest",
    "cu.data.7.OtherNorthEast",
    "cu.data.8.OtherNorthCentral",
    "cu.data.9.OtherSouth",
    "cu.data.10.OtherWest",
    "cu.data.11.USFoodBeverage",
    "cu.data.12.USHousing",
    "cu.data.13.USApparel",
    "cu.data.14.USTransportation",
    "cu.data.15.USMedical",
    "cu.data.16.USRecreation",
    "cu.data.17.USEducationAndCommunication",
    "cu.data.18.USOtherGoodsAndServices",
    "cu.data.19.PopulationSize",
    "cu.data.20.USCommoditiesServicesSpecial",
]

# Values for columns a file does not have; any other missing column is an error.
ABSENT = {
    "display_level": "0",
    "selectable": "F",
    "sort_sequence": "0",
    "series_title": "",
    "base_period": "",
    "begin_year": "0",
    "begin_period": "",
    "end_year": "0",
    "end_period": "",
    "footnote_codes": "",
}

FILE_ORDER = ["_block", "_row"]


def _column_name(header: str) -> str:
    name = header.strip().lower().replace(" ", "_")
    return "period" if name == "period_code" else name


def read_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-text table with normalised names, trimmed cells and no blank rows.

    ``_block`` and ``_row`` give the order of the rows in the file. Several files are one scan; their
    header lines must be the same but for padding and case, which the scan checks file by file.
    """
    several = not isinstance(path, str)
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', enforceSchema=not several,
                         ignoreLeadingWhiteSpace=several, ignoreTrailingWhiteSpace=several)
    cells = [strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(_column_name(c))
             for c in raw.columns]
    names = [_column_name(c) for c in raw.columns]
    table = raw.select(
        *cells,
        *([_file_number(path).alias("_file")] if several else []),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return table.filter(F.concat(*names) != "")


def _file_number(paths: list[str]) -> Column:
    """Place of the row's file in ``paths``, by its name or that of its folder."""
    names = F.array(*[F.lit(quote(path.rstrip("/").rsplit("/", 1)[-1], safe="+$&,:;=@!~*'()")) for path in paths])
    steps = F.split(F.col("_metadata.file_path"), "/")
    place = [F.array_position(names, F.element_at(steps, -k)) for k in (1, 2)]
    return F.greatest(*place) - 1


def _text(table: DataFrame, name: str) -> Column:
    if name in table.columns:
        return F.col(name)
    if name in ABSENT:
        return F.lit(ABSENT[name])
    raise ValueError(f"column {name!r} is missing")


def read_dimension(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Area, item, period, footnote or series file; the last row of a code wins."""
    table = read_tsv(spark, path)
    columns = []
    for field in SCHEMAS[name].fields:
        source = "period" if field.name == "period_code" else field.name
        text = _text(table, source)
        kind = field.dataType.simpleString()
        if kind == "boolean":
            text = to_bool(text)
        elif kind == "int":
            text = strict_int(text, field.name)
        columns.append(text.alias(field.name))
    return last_wins(table.select(*columns, *FILE_ORDER), KEYS[name], FILE_ORDER).select(
        SCHEMAS[name].fieldNames()
    )


def _observation_rows(table: DataFrame, year: Column, value: Column) -> DataFrame:
    order = [c for c in ("_file", *FILE_ORDER) if c in table.columns]
    return table.select(
        "series_id",
        year.alias("year"),
        "period",
        value.alias("value"),
        footnote_list(_text(table, "footnote_codes")).alias("footnotes"),
        *order,
    )


def read_observations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One observation file, or several with the same header line in one scan (``_file`` is then the
    place in the list); a value or year that is no number fails the query."""
    table = read_tsv(spark, path)
    return _observation_rows(
        table, strict_int(F.col("year"), "year"), strict_value(F.col("value"))
    )


def read_observations_permissive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects): unreadable rows go to ``rejects`` as text."""
    table = read_tsv(spark, path)
    bad = is_bad_value(F.col("value")) | is_bad_int(F.col("year"))
    good = _observation_rows(
        table.filter(~bad), F.col("year").try_cast("int"), to_value(F.col("value"))
    )
    return good, table.filter(bad).drop(*FILE_ORDER)


def read_observation_files(
    spark: SparkSession,
    folder: str,
    files: list[str] | None = None,
    *,
    current_only: bool = False,
    same_header: bool = True,
) -> DataFrame:
    """Observations of several files (default: all); on a common key the earlier file wins.

    Files with the same header line are read in one scan; another header fails the query. With
    ``same_header=False`` each file is a scan of its own and may have columns in an order of its own.
    """
    paths = [f"{folder}/{name}" for name in files or (CURRENT_FILES if current_only else DATA_FILES)]
    if same_header and len({path.rstrip("/").rsplit("/", 1)[-1] for path in paths}) == len(paths):
        return first_wins(read_observations(spark, paths), KEYS["observation"], ["_file", *FILE_ORDER])
    parts = [read_observations(spark, path) for path in paths]
    return union_first_wins(parts, KEYS["observation"], FILE_ORDER)


def read_dataset(
    spark: SparkSession,
    folder: str,
    files: list[str] | None = None,
    *,
    current_only: bool = False,
) -> Tables:
    """All six tables from a folder of flat files."""
    dims = {n: read_dimension(spark, f"{folder}/{DIMENSION_FILES[n]}", n) for n in DIMENSIONS}
    return Tables(
        **dims,
        series=read_dimension(spark, f"{folder}/{SERIES_FILE}", "series"),
        observation=read_observation_files(spark, folder, files, current_only=current_only),
    )


def write_tsv(df: DataFrame, path: str) -> None:
    """Text columns as a tab-separated file set with a header; the form ``read_tsv`` reads."""
    df.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")
