"""Schema migrations: actions on DataFrames that check the schema before they build the plan, and can be reversed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Holds the row as it was while the actions of a nested migration run.
_ROW = "_row"


class MigrationError(ValueError):
    """The schema isn't one that the action can be applied to."""


def _need(df: DataFrame, field: str) -> None:
    if field not in df.columns:
        raise MigrationError(f"no field {field}")


def _free(df: DataFrame, field: str) -> None:
    if field in df.columns:
        raise MigrationError(f"field {field} exists")


@dataclass(frozen=True)
class AddField:
    """default is evaluated on the row as it was."""

    name: str
    default: Column

    def apply(self, df: DataFrame) -> DataFrame:
        _free(df, self.name)
        return df.withColumn(self.name, self.default)

    def reverse(self):
        return DropField(self.name, self.default)


@dataclass(frozen=True)
class DropField:
    """default: what the reverse action puts there."""

    name: str
    default: Column | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.drop(self.name)

    def reverse(self):
        return Irreversible(f"drop {self.name}") if self.default is None else AddField(self.name, self.default)


@dataclass(frozen=True)
class RenameField:
    name: str
    to: str

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        _free(df, self.to)
        return df.withColumnRenamed(self.name, self.to)

    def reverse(self):
        return RenameField(self.to, self.name)


@dataclass(frozen=True)
class TransformField:
    """f: from the field's column to its new value; back, if there is one."""

    name: str
    f: Callable[[Column], Column]
    back: Callable[[Column], Column] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, self.f(F.col(self.name)))

    def reverse(self):
        return Irreversible(f"transform {self.name}") if self.back is None else TransformField(self.name, self.back, self.f)


@dataclass(frozen=True)
class MandateField:
    """Nulls become the default."""

    name: str
    default: Column

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, F.coalesce(F.col(self.name), self.default))

    def reverse(self):
        return OptionalizeField(self.name, self.default)


@dataclass(frozen=True)
class OptionalizeField:
    """The field may be null from here on."""

    name: str
    default: Column

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, F.when(F.lit(True), F.col(self.name)))

    def reverse(self):
        return MandateField(self.name, self.default)


@dataclass(frozen=True)
class ChangeFieldType:
    """Convert by cast; values that don't fit become null."""

    name: str
    to: str
    was: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, F.col(self.name).try_cast(self.to))

    def reverse(self):
        return Irreversible(f"type of {self.name}") if self.was is None else ChangeFieldType(self.name, self.was, self.to)


@dataclass(frozen=True)
class RenameCase:
    """Rename one value of a tag field; others stay."""

    name: str
    case: str
    to: str

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, F.when(F.col(self.name) == self.case, self.to).otherwise(F.col(self.name)))

    def reverse(self):
        return RenameCase(self.name, self.to, self.case)


@dataclass(frozen=True)
class TransformElements:
    """Map the items of an array field."""

    name: str
    f: Callable[[Column], Column]

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, F.transform(self.name, self.f))

    def reverse(self):
        return Irreversible(f"elements of {self.name}")


@dataclass(frozen=True)
class TransformKeys:
    name: str
    f: Callable[[Column], Column]

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, F.transform_keys(self.name, lambda k, _: self.f(k)))

    def reverse(self):
        return Irreversible(f"keys of {self.name}")


@dataclass(frozen=True)
class TransformValues:
    name: str
    f: Callable[[Column], Column]

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        return df.withColumn(self.name, F.transform_values(self.name, lambda _, v: self.f(v)))

    def reverse(self):
        return Irreversible(f"values of {self.name}")


@dataclass(frozen=True)
class MigrateField:
    """Apply a migration to the fields of a struct field; null structs stay null."""

    name: str
    migration: Migration

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        kind = df.schema[self.name].dataType
        if not isinstance(kind, T.StructType):
            raise MigrationError(f"field {self.name} is no struct")
        if _ROW in kind.names:
            raise MigrationError(f"field {_ROW} is reserved")
        held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(_ROW), *(F.col(f"`{self.name}`")[c].alias(c) for c in kind.names))
        inner = self.migration.apply(held)
        made = F.struct(*(F.col(f"`{c}`") for c in inner.columns if c != _ROW))
        value = F.when(F.col(_ROW)[self.name].isNotNull(), made)
        return inner.select(*(value.alias(c) if c == self.name else F.col(_ROW)[c].alias(c) for c in df.columns))

    def reverse(self):
        return MigrateField(self.name, self.migration.reverse())


@dataclass(frozen=True)
class TransformCase:
    """Apply a migration to the rows of one case of a tag field, the others stay.

    All cases share a schema, so the migration must keep it; a case that has a struct of its
    own can be given other fields by MigrateField. Rows without a tag are of no case. The
    reverse finds the rows by the tag as it is then.
    """

    name: str
    case: str
    migration: Migration

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.name)
        _free(df, _ROW)
        made = self.migration.apply(df.withColumn(_ROW, F.struct(*(F.col(f"`{c}`") for c in df.columns))))
        kinds = {f.name: f.dataType for f in made.schema if f.name != _ROW}
        if kinds != {f.name: f.dataType for f in df.schema}:
            raise MigrationError(f"the schema of case {self.case} isn't kept")
        here = F.col(_ROW)[self.name] == self.case
        return made.select(*(F.when(here, F.col(f"`{c}`")).otherwise(F.col(_ROW)[c]).alias(c) for c in df.columns))

    def reverse(self):
        return TransformCase(self.name, self.case, self.migration.reverse())


@dataclass(frozen=True)
class Irreversible:
    """Stands for an action that can't be undone; applying it fails."""

    what: str

    def apply(self, df: DataFrame) -> DataFrame:
        raise MigrationError(f"can't be reversed: {self.what}")

    def reverse(self):
        return self


@dataclass(frozen=True)
class Migration:
    """Actions in order; the first that fails ends it."""

    actions: tuple

    def __add__(self, other: Migration) -> Migration:
        return Migration(self.actions + other.actions)

    def apply(self, df: DataFrame) -> DataFrame:
        for action in self.actions:
            df = action.apply(df)
        return df

    def reverse(self) -> Migration:
        return Migration(tuple(a.reverse() for a in reversed(self.actions)))
