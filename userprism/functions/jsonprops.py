"""Unpacking of JSON property columns with Spark's variant type."""

from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scale import col


def parsed(column):
    """The text as a variant; null where it is not valid JSON."""
    return F.try_parse_json(column)


def is_object(variant):
    return F.schema_of_variant(variant).startswith("OBJECT<")


def has_nested(variant):
    """Whether any value of the object is itself an object; null unless it is an object."""
    values = F.map_values(F.from_json(variant.cast("string"), "map<string,variant>"))
    return F.when(is_object(variant), F.exists(values, is_object))


def nested_flag(df, column, name="is_nested"):
    return df.withColumn(name, has_nested(parsed(col(column))))


def json_status(df, column):
    """Rows by kind: object, other valid JSON, bad JSON, missing."""
    variant = parsed(col(column))
    kind = (
        F.when(col(column).isNull(), "missing")
        .when(variant.isNull(), "bad")
        .when(is_object(variant), "object")
        .otherwise("other")
    )
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def property_pairs(df, column, id):
    """Top-level properties in long form: one row (id, path, type, value) per property.

    The keys stay data, so any number of them is fine. Rows with bad or missing JSON, or JSON
    that is no object, give none; a nested object or list is given as JSON text.
    """
    pairs = F.from_json(F.col("__v").cast("string"), "map<string,variant>")
    objects = df.select(col(id), parsed(col(column)).alias("__v")).filter(is_object(F.col("__v")))
    return objects.select(col(id), F.explode(pairs).alias("path", "__p")).select(
        col(id), "path", F.regexp_extract(F.schema_of_variant("__p"), "^[A-Z]+", 0).alias("type"),
        F.col("__p").cast("string").alias("value"),
    )


def _step(key):
    if isinstance(key, int):
        return f"[{key}]"
    return f'["{key}"]' if "'" in key else f"['{key}']"


def value_at(variant, steps, kind):
    """The value below ``steps`` (keys or positions), or null where there is none of the kind."""
    path = "$"
    for step in steps:
        if isinstance(step, str) and "'" in step and '"' in step:
            # A path cannot quote such a key; look it up in a map instead.
            values = F.from_json(F.try_variant_get(variant, path, "string"), "map<string,variant>")
            variant, path = F.try_element_at(values, F.lit(step)), "$"
        else:
            path += _step(step)
    return F.try_variant_get(variant, path, kind)


def extract_keys(df, column, keys=("balance_type", "position_id", "instrument_type")):
    """Named keys as text columns; missing where the object is nested or lacks the key."""
    variant = parsed(col(column))
    flat = has_nested(F.col("__v")) == F.lit(False)
    found = {
        k: F.when(flat, value_at(F.col("__v"), [k], "string")) for k in keys
    }
    return df.withColumn("__v", variant).withColumns(found).drop("__v")


def property_schema(df, column):
    """Schema of all JSON objects in a column, merged over the whole table.

    One text comes back to the driver; pass the result on to keep the columns fixed.
    """
    objects = df.select(parsed(col(column)).alias("v")).filter(is_object(F.col("v")))
    text = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if text is None or text == "VOID":
        return T.StructType([])
    return T.StructType.fromDDL("v " + _as_struct(text))["v"].dataType


def _as_struct(text):
    """Write OBJECT types as STRUCT types, leaving quoted key names alone."""
    pieces = text.split("`")
    return "`".join(p.replace("OBJECT<", "STRUCT<") if i % 2 == 0 else p for i, p in enumerate(pieces))


def _leaf_type(data_type):
    if isinstance(data_type, (T.DecimalType, T.FloatType)):
        return "double"
    if isinstance(data_type, (T.VariantType, T.NullType, T.ArrayType, T.StructType)):
        return "string"
    return data_type.simpleString()


def _leaves(data_type, steps=()):
    """(steps, type) of every value; a list gives its first element."""
    for f in data_type.fields:
        below, kind = (*steps, f.name), f.dataType
        if isinstance(kind, T.StructType):
            yield from _leaves(kind, below)
        elif isinstance(kind, T.ArrayType):
            yield (*below, 0), _leaf_type(kind.elementType)
        else:
            yield below, _leaf_type(kind)


def unpack_properties(df, column, schema=None, prefix=""):
    """Every property as a column: nested keys joined by ``_``, lists by their first element.

    Rows with bad or missing JSON keep their other columns and get no properties. A flat key
    and a nested path of the same name share a column. Mixed types come out as text.
    """
    schema = schema or property_schema(df, column)
    by_name = defaultdict(list)
    for steps, kind in _leaves(schema):
        name = "_".join(s for s in steps if isinstance(s, str))
        by_name[prefix + name].append((steps, kind))
    taken = set(by_name) & set(df.columns)
    if taken:
        raise ValueError(f"property names already used: {sorted(taken)}")
    columns = {}
    for name, places in by_name.items():
        kinds = {k for _, k in places}
        kind = kinds.pop() if len(kinds) == 1 else "string"
        columns[name] = F.coalesce(*[value_at(F.col("__v"), steps, kind) for steps, _ in places])
    return df.withColumn("__v", parsed(col(column))).withColumns(columns).drop("__v")
