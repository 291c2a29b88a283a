"""Nested snapshots to flat columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()):
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, here)
        else:
            yield here


def flatten_structs(df: DataFrame, sep: str = "_") -> DataFrame:
    """Every struct field as a column named by its joined path; arrays and maps stay as they are."""
    columns: list[Column] = []
    names: set[str] = set()
    for path in _leaves(df.schema):
        name = sep.join(path)
        if name in names:
            raise ValueError(f"two fields flatten to the same column: {name}")
        names.add(name)
        columns.append(F.col(".".join(f"`{part}`" for part in path)).alias(name))
    return df.select(*columns)


def explode_records(
    df: DataFrame,
    array: str,
    position: str | None = None,
    schema: T.StructType | None = None,
    text: str | None = None,
) -> DataFrame:
    """One row per array element, its fields beside the other columns; empty arrays give none.

    ``position`` adds the element's place. Elements that are JSON text are parsed with
    ``schema``; ``text`` then keeps that text in a column of this name.
    """
    others = [c for c in df.columns if c != array]
    element = F.col("_element") if schema is None else F.from_json("_element", schema)
    return (
        df.select(*others, F.posexplode(array).alias("_place", "_element"))
        .select(
            *others,
            *([] if position is None else [F.col("_place").alias(position)]),
            *([] if text is None else [F.col("_element").alias(text)]),
            element.alias("_record"),
        )
        .select("*", "_record.*")
        .drop("_record")
    )


def array_length(array: str | Column) -> Column:
    """Number of elements; a missing array counts 0."""
    return F.coalesce(F.size(array), F.lit(0))


def arrays_to_json(df: DataFrame) -> DataFrame:
    """Array and map columns as JSON text, for sinks that hold text only."""
    return df.select(
        *[
            F.to_json(f.name).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def undeclared_fields(df: DataFrame, text: str, declared: Sequence[str]) -> DataFrame:
    """(field, dtype, present, rows): top-level fields of JSON objects beyond ``declared``.

    The type is the one that all values of a field fit, by Spark's merging of variant schemas.
    ``present`` counts the rows that have the field, null or not; ``rows`` all that are objects.
    Text that is no JSON object counts as none. One pass, and one row per field.
    """
    known = set(declared)
    parsed = df.select(F.try_parse_json(text).alias("v")).filter(
        F.schema_of_variant("v").startswith("OBJECT")
    )
    # Keys are listed as a map's, values typed as variants and merged field by field.
    fields = parsed.select(
        F.explode(F.variant_get("v", "$", "map<string, variant>")).alias("field", "value")
    ).filter(~F.col("field").isin(sorted(known)) if known else F.lit(True))
    total = parsed.select(F.count("*")).scalar()
    found = fields.groupBy("field").agg(
        F.schema_of_variant_agg("value").alias("dtype"), F.count("*").alias("present")
    )
    return found.withColumn("rows", total)
