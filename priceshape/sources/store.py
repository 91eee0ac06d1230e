"""Parquet store of the six tables.

Each table is a folder of Parquet files, the observations laid out by year and period. A change is
written to scratch and checked there; then Spark replaces the parts it touches (dynamic partition
overwrite), so an upsert rewrites the months it has rows of, and a job that fails leaves them as they
were. Tables that others refer to are written first and rows that refer to others are deleted first,
so no reader of an append, upsert or delete meets a broken reference. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceshape.operators.dedup import last_wins, upsert
from priceshape.operators.integrity import require_integrity
from priceshape.schemas import COLUMN_DEFAULTS, KEYS, SCHEMAS, Tables
from priceshape.scratch import pin


def with_defaults(table: DataFrame, name: str) -> DataFrame:
    """An older table in its present form: columns added later hold their defaults."""
    columns = []
    for field in SCHEMAS[name].fields:
        default = COLUMN_DEFAULTS.get(name, {}).get(field.name)
        value = F.col(field.name) if field.name in table.columns else F.lit(None)
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        elif field.name not in table.columns:
            raise ValueError(f"{name}: column {field.name!r} is missing")
        columns.append(value.cast(field.dataType).alias(field.name))
    return table.select(columns)


#: Columns that the files of a table are laid out by. A table without natural parts is one part.
PARTS = {"observation": ["year", "period"]}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # Reading

    def _found(self, name: str) -> DataFrame | None:
        try:
            # A column the files lack reads as NULL.
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _read(self, name: str) -> DataFrame:
        found = self._found(name)
        if found is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return with_defaults(found, name)

    def exists(self) -> bool:
        return self._found("series") is not None

    def read(self) -> Tables:
        return Tables(**{name: self._read(name) for name in SCHEMAS})

    # Writing

    def _write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        """Write the parts that ``df`` has rows of; in place of what they held, or beside it."""
        parts = PARTS.get(name, ["part"])
        rows = df.select(SCHEMAS[name].fieldNames())
        if parts == ["part"]:
            rows = rows.withColumn("part", F.lit(0))
        else:
            rows = rows.hint("rebalance", *parts)
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{name}")

    def _empty(self, name: str, places: list[tuple]) -> None:
        """Leave the given parts without rows."""
        parts = PARTS.get(name, ["part"])
        none = self.spark.createDataFrame([], T.StructType([f for f in SCHEMAS[name].fields if f.name not in parts]))

        def empty(place: tuple) -> None:
            folder = "/".join(f"{c}={quote(str(v), safe='')}" for c, v in zip(parts, place, strict=True))
            none.write.mode("overwrite").parquet(f"{self.root}/{name}/{folder}")

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(empty, places))

    def _places(self, name: str, df: DataFrame) -> set[tuple]:
        """The parts that have rows: a month each, or the one part of a table."""
        if name not in PARTS:
            return set() if df.isEmpty() else {(0,)}
        return {tuple(r) for r in df.select(*PARTS[name]).distinct().collect()}

    def _replace(self, name: str, df: DataFrame, before: set[tuple]) -> None:
        """``df`` in place of the parts ``before``; those it has no rows of end up without any."""
        self._write(name, df)
        if before:
            self._empty(name, sorted(before - self._places(name, df)))

    def ensure_schema(self) -> None:
        """Create the tables that do not exist yet, empty."""
        for name in SCHEMAS:
            if self._found(name) is None:
                self._write(name, self.spark.createDataFrame([], SCHEMAS[name]), "append")

    def load(self, tables: Tables, *, truncate: bool = True) -> None:
        """Replace all tables, or append to them; a key that occurs twice is an error.

        The incoming tables are read once; what was read is checked before anything of it is stored.
        """
        names = list(SCHEMAS)
        with ThreadPoolExecutor(len(names)) as pool:  # small jobs side by side
            incoming = dict(zip(names, pool.map(lambda n: _incoming(tables.get(n), n), names), strict=True))
        none = {name: self.spark.createDataFrame([], SCHEMAS[name]) for name in names}
        current = none if truncate else {name: self._read(name) for name in names}
        problems = []
        for name, table in incoming.items():
            problems.append(_repeated(table, name))
            clash = table.join(current[name], KEYS[name], "left_semi")
            problems.append(clash.select(F.lit(f"{name}: keys to load are already in the store").alias("p")))
        _fail(problems)
        parents = {name: incoming[name].unionByName(current[name]) for name in names if name != "observation"}
        require_integrity(Tables(**parents, observation=incoming["observation"]))

        def store(name: str) -> None:
            if truncate:
                self._replace(name, incoming[name], self._places(name, self._read(name)))
            else:
                self._write(name, incoming[name], "append")

        # A level of references at a time, parents first.
        for level in ([n for n in names if n not in ("series", "observation")], ["series"], ["observation"]):
            with ThreadPoolExecutor(len(level)) as pool:
                list(pool.map(store, level))

    def _merged(self, incoming: Tables) -> dict[str, DataFrame]:
        """The dimension and series tables with the incoming rows, written once."""
        names = [n for n in SCHEMAS if n != "observation"]
        rows = {n: _incoming(incoming.get(n), n) for n in names}
        _fail([_repeated(rows[n], n) for n in names])
        with ThreadPoolExecutor(len(names)) as pool:
            merged = pool.map(lambda n: pin(upsert(self._read(n), rows[n], KEYS[n]), n), names)
            return dict(zip(names, merged, strict=True))

    def _store_merged(self, merged: dict[str, DataFrame]) -> None:
        parents = [n for n in merged if n != "series"]
        with ThreadPoolExecutor(len(parents)) as pool:
            list(pool.map(lambda n: self._write(n, merged[n]), parents))
        self._write("series", merged["series"])

    def _store_observations(self, incoming: DataFrame, places: set[tuple]) -> None:
        """Rewrite the months of a written table of observations, the incoming row winning."""
        if places:
            self._write("observation", upsert(_within(self._read("observation"), places), incoming, KEYS["observation"]))

    def sync_metadata(self, incoming: Tables) -> None:
        """Upsert the dimension and series tables; observations stay as they are."""
        merged = self._merged(incoming)
        require_integrity(Tables(**merged, observation=self.spark.createDataFrame([], SCHEMAS["observation"])))
        self._store_merged(merged)

    def upsert_observations(
        self,
        incoming: DataFrame,
        order: list[str] | None = None,
        note: Callable[[set[tuple[int, str]]], None] | None = None,
    ) -> set[tuple[int, str]]:
        """Insert or replace observations; of repeated keys the last in ``order`` counts.

        Returns the months (year, period) in which a value is new or another than before; ``note`` gets
        them before anything is written.
        """
        incoming = _incoming(incoming, "observation", order)
        _fail([_repeated(incoming, "observation")])
        require_integrity(replace(self.read(), observation=incoming), ("observation",))
        places = self._places("observation", incoming)
        before = _within(self._read("observation"), places)
        keys = KEYS["observation"]
        same = before.select(*keys, F.col("value").alias("_before"), F.lit(True).alias("_known"))
        changed = incoming.join(same, keys, "left").filter("_known IS NULL OR NOT (value <=> _before)")
        months = self._places("observation", changed)
        if note is not None:
            note(months)
        self._store_observations(incoming, places)
        return months

    def merge(self, incoming: Tables) -> None:
        """Upsert everything; what observations refer to is stored before them."""
        observation, merged = _incoming(incoming.observation, "observation"), self._merged(incoming)
        _fail([_repeated(observation, "observation")])
        require_integrity(Tables(**merged, observation=observation))
        self._store_merged(merged)
        self._store_observations(observation, self._places("observation", observation))

    def delete(self, series: DataFrame) -> None:
        """Delete the given series and, before them, their observations."""
        ids = pin(series.select("series_id").distinct(), "deleted")
        tables = self.read()
        places = self._places("observation", tables.observation.join(ids, "series_id", "left_semi"))
        kept = delete_series(replace(tables, observation=_within(tables.observation, places)), ids)
        if places:
            self._replace("observation", pin(kept.observation, "kept"), places)
        self._replace("series", pin(kept.series, "kept"), self._places("series", tables.series))


def _within(observations: DataFrame, places: set[tuple]) -> DataFrame:
    """The observations of some months, by a condition that prunes the files."""
    years: dict[int, list[str]] = {}
    for year, period in sorted(places):
        years.setdefault(year, []).append(period)
    wanted = F.lit(False)
    for year, periods in years.items():
        wanted = wanted | ((F.col("year") == year) & F.col("period").isin(periods))
    return observations.filter(wanted)


def _repeated(table: DataFrame, name: str) -> DataFrame:
    found = table.groupBy(*KEYS[name]).count().filter("count > 1")
    return found.select(F.lit(f"{name}: a key occurs more than once").alias("p"))


def _fail(problems: list[DataFrame]) -> None:
    found = reduce(DataFrame.union, problems).limit(1).collect()
    if found:
        raise ValueError(found[0]["p"])


def _incoming(rows: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Rows as they are stored, written once because they are read several times; of repeated keys the
    last in ``order``."""
    columns = SCHEMAS[name].fieldNames()
    if order:
        rows = last_wins(rows.select(*columns, *order), KEYS[name], order)
    rows = rows.select(columns)
    if name == "observation":
        rows = rows.withColumns({
            "footnotes": F.when(F.size("footnotes") > 0, F.col("footnotes")),
            "period": F.expr("if(year IS NULL OR coalesce(period, '') = '', raise_error('observation without a month'), period)")})
    return pin(rows, "incoming")


def delete_series(tables: Tables, series: DataFrame) -> Tables:
    """Tables without the given series and, with them, their observations."""
    ids = series.select("series_id")
    kept = {name: table for name, table in tables.items()}
    for name in ("series", "observation"):
        kept[name] = kept[name].join(ids, "series_id", "left_anti").select(
            SCHEMAS[name].fieldNames()
        )
    return Tables(**kept)


def export_ordered(tables: Tables) -> Tables:
    """Every table in key order, as a store is read for export."""
    return Tables(**{n: t.orderBy(*KEYS[n]) for n, t in tables.items()})
