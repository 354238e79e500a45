"""Reading loosely typed payload members.

A member may be absent, null or of any JSON type. Text members are read as "the
value or nothing": falsy values of any type count as blank, and a truthy value
that is not a string makes the row bad, which ``not_text`` tells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def string_or_null(value: Column) -> Column:
    """The value if it is a JSON string, NULL for every other type."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def not_text(value: Column) -> Column:
    """True for a truthy value that is not a string; never NULL."""
    name = kind(value)
    empty = name.isin("VOID", "STRING", "OBJECT<>", "ARRAY<VOID>") & (
        # A list of nulls has the same schema as an empty list.
        (name != "ARRAY<VOID>") | F.try_variant_get(value, "$[0]", "variant").isNull()
    )
    zero = F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False))
    return value.isNotNull() & ~F.when(name == "STRING", True).otherwise(empty | zero)


def members(value: Column, *names: str) -> Column:
    """The named members as variants if the value is an object, else NULL."""
    fields = ", ".join(f"{name}: variant" for name in names)
    return F.try_variant_get(value, "$", f"struct<{fields}>")
