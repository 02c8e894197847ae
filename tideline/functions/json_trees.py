"""Whole-tree operations on JSON text columns: selections, entries, pruning, rewriting, schema checks.

A selection is an array of JSON texts, so that its filters, maps and folds are Spark's own
array functions. Callables get (path, value), path being a tuple of names and positions;
they run in Arrow batches and must be importable or self-contained.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.json_values import ANY, _udf, dumps, json_type, loads, same

_ENTRY = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
_ENTRY_ARROW = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string())]))


def kind_of(v) -> str:
    if v is None:
        return "null"
    for kind, name in ((bool, "boolean"), ((int, float, Decimal), "number"), (str, "string"), (list, "array"), (dict, "object")):
        if isinstance(v, kind):
            return name
    raise TypeError(v)


def parsed(text: str | None):
    """(value, whether it is JSON)."""
    try:
        return (None, False) if text is None else (loads(text), True)
    except (ValueError, RecursionError):
        return None, False


def walk(v, path: tuple = ()):
    """(path, value) of every node, parents first."""
    todo = [(path, v)]
    while todo:
        path, v = todo.pop()
        yield path, v
        if isinstance(v, dict):
            todo += [((*path, k), v[k]) for k in reversed(v)]
        elif isinstance(v, list):
            todo += [((*path, k), v[k]) for k in range(len(v) - 1, -1, -1)]


def shown(path: Sequence) -> str:
    """A path as text: .name and [position]."""
    return "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)


def _entries(leaves_only: bool):
    @F.arrow_udf(_ENTRY)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            v, ok = parsed(t)
            nodes = [(p, x) for p, x in walk(v) if not leaves_only or not isinstance(x, (dict, list)) or not x] if ok else None
            out.append(None if nodes is None else [{"path": shown(p), "kind": kind_of(x), "value": dumps(x)} for p, x in nodes])
        return pa.array(out, _ENTRY_ARROW)

    return run


def entries(doc: Column) -> Column:
    """(path, kind, value) of every node, parents first: what folds and searches run over."""
    return _entries(False)(doc)


def leaves(doc: Column) -> Column:
    """(path, kind, value) of the leaves and of empty containers."""
    return _entries(True)(doc)


_STEP = re.compile(r"\.([^.\[]*)|\[([0-9]+)\]")


def rebuilt(pairs: Sequence[tuple[str, str]]):
    """A tree from (path, value) pairs; names must be without dots and brackets."""
    root = None
    for path, value in pairs:
        steps = [m[1] if m[2] is None else int(m[2]) for m in _STEP.finditer(path)]
        root = _put(root, steps, json.loads(value))
    return root


def _put(v, steps: list, value):
    if not steps:
        return value
    k = steps[0]
    if isinstance(k, int):
        v = v if isinstance(v, list) else []
        if k > len(v):
            raise ValueError(f"gap before [{k}]")
        return [*v[:k], _put(v[k] if k < len(v) else None, steps[1:], value), *v[k + 1 :]]
    v = v if isinstance(v, dict) else {}
    return {**v, k: _put(v.get(k), steps[1:], value)}


@F.arrow_udf(T.StringType())
def from_leaves(leaves: pa.Array) -> pa.Array:
    """The JSON text of an array of (path, kind, value)."""
    return pa.array([None if x is None else dumps(rebuilt([(e["path"], e["value"]) for e in x])) for x in leaves.to_pylist()], pa.string())


# -- selections -----------------------------------------------------------------------------


def found(v, path: Sequence) -> list:
    """The values at a path, in order; a step that doesn't fit finds nothing."""
    values = [v]
    for step in path:
        after = []
        for x in values:
            if step is ANY:
                after += x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
            elif isinstance(step, int):
                after += x[step : step + 1] if isinstance(x, list) and step >= 0 else []
            elif isinstance(x, dict) and step in x:
                after.append(x[step])
        values = after
    return values


def select(doc: Column, path: Sequence) -> Column:
    """The selection at a path; empty where it is absent, null for malformed JSON."""
    steps = list(path)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [parsed(t) for t in texts.to_pylist()]
        return pa.array([[dumps(x) for x in found(v, steps)] if ok else None for v, ok in rows], pa.list_(pa.string()))

    return run(doc)


def of_kind(selection: Column, kind: str) -> Column:
    return F.filter(selection, lambda x: json_type(x) == kind)


def one(selection: Column, strict: bool = False) -> Column:
    """The only value; null, or an error, for none or several."""
    none = F.raise_error(F.lit("not exactly one value")) if strict else F.lit(None)
    return F.when(F.size(selection) == 1, F.get(selection, F.lit(0))).otherwise(none)


def first(selection: Column) -> Column:
    return F.get(selection, F.lit(0))


def all_values(selection: Column) -> Column:
    """The only value, or the array of all."""
    return F.when(F.size(selection) == 1, F.get(selection, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(selection, ","), F.lit("]")))


def or_else(selection: Column, other: Column) -> Column:
    return F.when(F.size(selection) > 0, selection).otherwise(other)


def search(doc: Column, test: Callable) -> Column:
    """The selection of all nodes for which test(path, value) holds, parents first."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [parsed(t) for t in texts.to_pylist()]
        return pa.array([[dumps(x) for p, x in walk(v) if test(p, x)] if ok else None for v, ok in rows], pa.list_(pa.string()))

    return run(doc)


# -- rewriting --------------------------------------------------------------------------------


def pruned(v, test: Callable, path: tuple = ()):
    """v without the members and items for which test holds."""
    if isinstance(v, dict):
        return {k: pruned(x, test, (*path, k)) for k, x in v.items() if not test((*path, k), x)}
    if isinstance(v, list):
        return [pruned(x, test, (*path, i)) for i, x in enumerate(v) if not test((*path, i), x)]
    return v


def retained(v, test: Callable, path: tuple = ()):
    """(kept, value): nodes for which test holds, whole, and what leads to them."""
    if test(path, v):
        return True, v
    if isinstance(v, dict):
        out = {k: y for k, x in v.items() for ok, y in [retained(x, test, (*path, k))] if ok}
        return bool(out), out
    if isinstance(v, list):
        out = [y for i, x in enumerate(v) for ok, y in [retained(x, test, (*path, i))] if ok]
        return bool(out), out
    return False, None


def changed_up(v, f: Callable, path: tuple = ()):
    """f(path, value) applied to every node, children first."""
    if isinstance(v, dict):
        v = {k: changed_up(x, f, (*path, k)) for k, x in v.items()}
    elif isinstance(v, list):
        v = [changed_up(x, f, (*path, i)) for i, x in enumerate(v)]
    return f(path, v)


def changed_down(v, f: Callable, path: tuple = ()):
    """f(path, value) applied to every node, parents first."""
    v = f(path, v)
    if isinstance(v, dict):
        return {k: changed_down(x, f, (*path, k)) for k, x in v.items()}
    return [changed_down(x, f, (*path, i)) for i, x in enumerate(v)] if isinstance(v, list) else v


def renamed(v, f: Callable, path: tuple = ()):
    """Member names replaced by f(path, name); of equal new names the last wins."""
    if isinstance(v, dict):
        return {f((*path, k), k): renamed(x, f, (*path, k)) for k, x in v.items()}
    return [renamed(x, f, (*path, i)) for i, x in enumerate(v)] if isinstance(v, list) else v


def prune(doc: Column, test: Callable) -> Column:
    return _udf(lambda v: pruned(v, test))(doc)


def retain(doc: Column, test: Callable) -> Column:
    """Only what test holds for, and what leads there; an empty container of the root's kind, or null, for nothing."""
    return _udf(lambda v: retained(v, test)[1])(doc)


def partition(doc: Column, test: Callable) -> Column:
    return F.struct(retain(doc, test).alias("retained"), prune(doc, test).alias("rest"))


def project(doc: Column, paths: Sequence[Sequence]) -> Column:
    """Only the listed paths, and what leads there."""
    wanted = [tuple(p) for p in paths]
    fits = lambda path: any(len(w) == len(path) and all(a is ANY or a == b for a, b in zip(w, path)) for w in wanted)
    return retain(doc, lambda path, _: fits(path))


def transform_up(doc: Column, f: Callable) -> Column:
    return _udf(lambda v: changed_up(v, f))(doc)


def transform_down(doc: Column, f: Callable) -> Column:
    return _udf(lambda v: changed_down(v, f))(doc)


def transform_keys(doc: Column, f: Callable) -> Column:
    return _udf(lambda v: renamed(v, f))(doc)


# -- schema -------------------------------------------------------------------------------------

_KINDS = {"integer": lambda v: kind_of(v) == "number" and v == int(v)}


def first_error(v, schema, path: tuple = ()) -> str | None:
    """The first place where v breaks a JSON Schema, as text; the keywords below, others are ignored."""
    here = shown(path) or "."
    if schema is True or schema is False:
        return None if schema else f"{here}: not allowed"
    kind = kind_of(v)
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_KINDS[t](v) if t in _KINDS else t == kind for t in types):
            return f"{here}: not {' or '.join(types)}"
    checks = {
        "const": lambda x: same(v, x),
        "enum": lambda x: any(same(v, y) for y in x),
        "minimum": lambda x: kind != "number" or v >= x,
        "maximum": lambda x: kind != "number" or v <= x,
        "exclusiveMinimum": lambda x: kind != "number" or v > x,
        "exclusiveMaximum": lambda x: kind != "number" or v < x,
        "multipleOf": lambda x: kind != "number" or Decimal(str(v)) % Decimal(str(x)) == 0,
        "minLength": lambda x: kind != "string" or len(v) >= x,
        "maxLength": lambda x: kind != "string" or len(v) <= x,
        "pattern": lambda x: kind != "string" or re.search(x, v) is not None,
        "minItems": lambda x: kind != "array" or len(v) >= x,
        "maxItems": lambda x: kind != "array" or len(v) <= x,
        "uniqueItems": lambda x: kind != "array" or not x or len({dumps(y) for y in v}) == len(v),
        "minProperties": lambda x: kind != "object" or len(v) >= x,
        "maxProperties": lambda x: kind != "object" or len(v) <= x,
        "required": lambda x: kind != "object" or all(k in v for k in x),
        "allOf": lambda x: all(first_error(v, s, path) is None for s in x),
        "anyOf": lambda x: any(first_error(v, s, path) is None for s in x),
        "oneOf": lambda x: sum(first_error(v, s, path) is None for s in x) == 1,
        "not": lambda x: first_error(v, x, path) is not None,
    }
    for word, ok in checks.items():
        if word in schema and not ok(schema[word]):
            return f"{here}: {word}"
    if kind == "object":
        known = schema.get("properties", {})
        for k, x in v.items():
            sub = known.get(k, schema.get("additionalProperties", True))
            if error := first_error(x, sub, (*path, k)):
                return error
    if kind == "array":
        prefix = schema.get("prefixItems", [])
        for i, x in enumerate(v):
            if error := first_error(x, prefix[i] if i < len(prefix) else schema.get("items", True), (*path, i)):
                return error
    return None


def check(doc: Column, schema: dict | bool) -> Column:
    """The first error against a JSON Schema, null if it conforms; malformed JSON is an error too."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        rows = [parsed(t) for t in texts.to_pylist()]
        return pa.array([first_error(v, schema) if ok else ".: not JSON" for v, ok in rows], pa.string())

    return run(doc)


def conforms(doc: Column, schema: dict | bool) -> Column:
    return check(doc, schema).isNull()
