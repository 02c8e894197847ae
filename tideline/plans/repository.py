"""Tables as repositories: typed SQL text with bound parameters, and copy-on-write changes.

A table is a folder of Parquet files, or a catalog table. Spark's files don't change in
place, so update and delete write the new contents to a folder of their own, from which
the table is then replaced; each returns how many rows it concerned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.scratch import written


class SqlError(ValueError):
    pass


def identifier(name: str) -> str:
    """A checked, quoted identifier."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise SqlError(f"not an identifier: {name!r}")
    return f"`{name}`"


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


@dataclass(frozen=True)
class Fragment:
    """SQL text with ? for its parameters; fragments add up."""

    text: str
    params: tuple = ()

    def __add__(self, other: Fragment) -> Fragment:
        return Fragment(self.text + other.text, self.params + other.params)

    def check(self) -> Fragment:
        """Not empty, and quotes and parentheses closed."""
        bare = re.sub(r"'(?:[^']|'')*'", "", self.text)
        if not self.text.strip() or "'" in bare or bare.count("(") != bare.count(")"):
            raise SqlError(f"malformed: {self.text}")
        return self

    def query(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        """Run it; tables are given to Spark by name."""
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(self.check().text, args=list(self.params))


def values(rows: Sequence[Sequence]) -> Fragment:
    """VALUES with a tuple for each row, at least one."""
    if not rows:
        raise SqlError("VALUES needs a row")
    one = "(" + ", ".join("?" * len(rows[0])) + ")"
    return Fragment("VALUES " + ", ".join([one] * len(rows)), tuple(x for r in rows for x in r))


@dataclass(frozen=True)
class Select:
    """A SELECT, built step by step; order keys and conditions add up."""

    table: str
    columns: tuple[str, ...] = ()
    where_: tuple[Fragment, ...] = ()
    order_: tuple[str, ...] = ()
    limit_: int | None = None

    def project(self, *columns: str) -> Select:
        return Select(self.table, columns, self.where_, self.order_, self.limit_)

    def where(self, text: str, *params) -> Select:
        return Select(self.table, self.columns, (*self.where_, Fragment(text, params)), self.order_, self.limit_)

    def order_by(self, column: str, descending: bool = False) -> Select:
        return Select(self.table, self.columns, self.where_, (*self.order_, identifier(column) + (" DESC NULLS LAST" if descending else " ASC NULLS LAST")), self.limit_)

    def limit(self, n: int) -> Select:
        return Select(self.table, self.columns, self.where_, self.order_, n)

    def render(self) -> Fragment:
        out = Fragment(f"SELECT {', '.join(map(identifier, self.columns)) or '*'} FROM {identifier(self.table)}")
        for i, w in enumerate(self.where_):
            out = out + Fragment(" WHERE (" if not i else " AND (") + w + Fragment(")")
        if self.order_:
            out = out + Fragment(" ORDER BY " + ", ".join(self.order_))
        return out + Fragment(f" LIMIT {int(self.limit_)}") if self.limit_ is not None else out


def create_table(name: str, schema: T.StructType) -> str:
    columns = ", ".join(f"{identifier(f.name)} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {identifier(name)} ({columns}) USING parquet"


def drop_table(name: str) -> str:
    return f"DROP TABLE IF EXISTS {identifier(name)}"


@dataclass
class Repository:
    """Rows with an id column, in a folder of Parquet files."""

    spark: SparkSession
    path: str
    schema: T.StructType
    id: str = "id"
    _ready: bool = field(default=False, repr=False)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def create(self) -> Repository:
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self.path)
        return self

    def _replace(self, df: DataFrame) -> None:
        written(df, "repository").write.mode("overwrite").parquet(self.path)

    def find(self, key) -> DataFrame:
        return self.all().filter(F.col(self.id) == F.lit(key))

    def find_all(self, keys: Iterable) -> DataFrame:
        """The rows of a list of ids; none for an empty list."""
        keys = list(keys)
        return self.all().filter(F.col(self.id).isin(keys) if keys else F.lit(False))

    def exists(self, key) -> bool:
        return not self.find(key).isEmpty()

    def count(self) -> int:
        return self.all().count()

    def insert(self, rows: Sequence[Sequence]) -> int:
        """Append rows; returns how many."""
        if rows:
            self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.path)
        return len(rows)

    def insert_from(self, df: DataFrame) -> None:
        df.select(*self.schema.names).write.mode("append").parquet(self.path)

    def update(self, changes: DataFrame) -> int:
        """Replace the rows whose ids are in changes, which has all columns; returns how many were replaced."""
        hit = self.all().join(changes.select(self.id), self.id, "left_semi")
        n = hit.count()
        if n:
            kept = self.all().join(changes.select(self.id), self.id, "left_anti")
            fresh = changes.join(hit.select(self.id).distinct(), self.id, "left_semi")
            self._replace(kept.select(*self.schema.names).unionByName(fresh.select(*self.schema.names)))
        return n

    def update_where(self, condition: Column, assignments: dict[str, Column]) -> int:
        here = F.coalesce(condition, F.lit(False))
        n = self.all().filter(here).count()
        if n:
            self._replace(self.all().select(*(F.when(here, assignments[c]).otherwise(F.col(c)).cast(self.schema[c].dataType).alias(c) if c in assignments else F.col(c) for c in self.schema.names)))
        return n

    def delete_where(self, condition: Column) -> int:
        here = F.coalesce(condition, F.lit(False))
        n = self.all().filter(here).count()
        if n:
            self._replace(self.all().filter(~here))
        return n

    def delete_all(self, keys: Iterable) -> int:
        keys = list(keys)
        return self.delete_where(F.col(self.id).isin(keys)) if keys else 0

    def clear(self) -> int:
        n = self.count()
        self._replace(self.all().limit(0))
        return n
