"""The table of registered queries, and fixture rows that Spark and DuckDB share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


class Fixture:
    """A few literal rows: frame(spark) for Spark, sql for DuckDB."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def over(self, name: str, key: str, text: str | None = None, into: str | None = None, first: bool = False) -> Dealt:
        """These rows dealt in turn over all rows of a table, by its key."""
        return Dealt(self, name, key, text, into, first)

    @property
    def sql(self) -> str:
        kinds = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]"}
        names, types = zip(*[part.strip().split(" ", 1) for part in self.schema.split(",")], strict=True)
        select = ", ".join(f'"{n}"::{kinds[t]} AS "{n}"' for n, t in zip(names, types, strict=True))
        rows = ",\n  ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(SELECT {select} FROM (VALUES {rows}) AS v({', '.join(f'"{n}"' for n in names)}))"


#: What stands between a table's text and the text dealt to its row: far enough that neither is context of the other.
FAR = "\n" + " ~" * 60 + "\n"


class Dealt:
    """A table each of whose rows has one of a fixture's rows beside it: id (the table's key), row (the fixture's own id, where it has one), own (the table's
    text, where one is named) and the fixture's other columns. With into, that column is the table's whole text and the fixture's behind it, or before it with first."""

    def __init__(self, fixture: Fixture, name: str, key: str, text: str | None, into: str | None, first: bool):
        self.fixture, self.name, self.key, self.text, self.into, self.first = fixture, name, key, text, into, first
        self.columns = [part.strip().split(" ", 1)[0] for part in fixture.schema.split(",")]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.name).select(F.col(self.key).alias("id"), *([F.col(self.text).alias("own")] if self.text else []))
        dealt = spark.createDataFrame([(n, *r) for n, r in enumerate(self.fixture.rows)], f"_n long, {self.fixture.schema}").withColumnsRenamed({"id": "row"})
        both = rows.join(F.broadcast(dealt), F.pmod(F.coalesce("id", F.lit(0)), F.lit(len(self.fixture.rows))) == F.col("_n")).drop("_n")
        return both.withColumn(self.into, F.concat_ws(FAR, *((self.into, "own") if self.first else ("own", self.into)))) if self.into else both

    @property
    def sql(self) -> str:
        n = len(self.fixture.rows)
        listed = f"(SELECT row_number() OVER () - 1 AS n, * FROM {self.fixture.sql})"
        far = "concat_ws(chr(10) || repeat(' ~', 60) || chr(10), {})"
        shown = [f"f.{c} AS {'row' if c == 'id' else c}" if c != self.into else far.format(f"f.{c}, d.{self.text}" if self.first else f"d.{self.text}, f.{c}") + f" AS {c}" for c in self.columns]
        own = [f"d.{self.text} AS own"] if self.text else []
        return f"(SELECT {', '.join([f'd.{self.key} AS id', *own, *shown])} FROM {self.name} d JOIN {listed} f ON (coalesce(d.{self.key}, 0) % {n} + {n}) % {n} = f.n)"
