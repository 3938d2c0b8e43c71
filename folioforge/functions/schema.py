"""A nested schema compiled to one column expression that names the first fault of a JSON value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _one_of(given: list, path: Column) -> Column:
    return F.concat(F.lit("Field "), path, F.lit(f" must be one of {given}."))


def _must(path: Column, what: str) -> Column:
    return F.concat(F.lit("Field "), path, F.lit(f" must be {what}."))


def fault(value: Column, schema: dict, path: Column | None = None) -> Column:
    """The first fault of a variant by schema, null without one.

    schema: type (OBJECT, ARRAY, BOOLEAN, INTEGER, STRING or none), nullable, required and properties, items, enum. Faults come in the order of a walk: a value's own type, its
    required fields in their order, then its properties in the schema's order or its items in theirs. Fields that the schema lacks are allowed. The schema is unrolled here, on the driver, once: one expression
    of nested conditions, in which only items of arrays are walked by a lambda.
    """
    path = F.lit("root") if path is None else path
    kind, wanted = schema.get("type"), schema.get("enum")
    found: Column = F.lit(None).cast("string")
    # F.when keeps what is below from being tried on a value of another kind
    if kind == "OBJECT":
        faults = [F.when(_field(value, name).isNull(), F.lit(f"Missing required field: {name}")) for name in schema.get("required", [])]
        for name, child in schema.get("properties", {}).items():
            inner = _field(value, name)
            faults.append(F.when(inner.isNotNull(), fault(inner, child, F.concat(path, F.lit(f".{name}")))))
        found = F.when(~_kind(value).startswith("OBJECT"), _must(path, "a JSON object")).otherwise(F.coalesce(*faults, F.lit(None).cast("string")))
    elif kind == "ARRAY":
        inside: Callable = lambda x, i: fault(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        items = F.try_element_at(F.array_compact(F.transform(F.try_variant_get(value, "$", "array<variant>"), inside)), F.lit(1)) if schema.get("items") else found
        found = F.when(~_kind(value).startswith("ARRAY"), _must(path, "a list")).otherwise(items)
    elif kind == "BOOLEAN":
        found = F.when(_kind(value) != "BOOLEAN", _must(path, "a boolean"))
    elif kind == "INTEGER":  # true and false count as 1 and 0; a decimal without places is one only where it is too long for a long, else it was written with a point
        found = F.when(~_kind(value).rlike(r"^(BIGINT|BOOLEAN|DECIMAL\((19|2\d|3\d),0\))$"), _must(path, "an integer"))
    elif kind == "STRING":
        text = F.try_variant_get(value, "$", "string")
        found = F.when(_kind(value) != "STRING", _must(path, "a string"))
        if wanted is not None:
            found = F.coalesce(found, F.when(~text.isin(wanted), _one_of(wanted, path)))
    elif wanted is not None:
        text = F.to_json(value)
        found = F.when(~text.isin([_json(x) for x in wanted]), _one_of(wanted, path))
    return F.when(~F.is_variant_null(value), found) if schema.get("nullable") else found


def _json(x) -> str:
    import json

    return json.dumps(x, ensure_ascii=False)


def _field(value: Column, name: str) -> Column:
    """A field as a variant; null if it is not there (a JSON null is a value)."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def json_fault(text: Column, schema: dict) -> Column:
    """The first fault of a JSON text; a text that is no JSON has its own, a null text too."""
    value = F.try_parse_json(text)
    return F.when(value.isNull(), F.lit("not JSON")).otherwise(fault(value, schema))
