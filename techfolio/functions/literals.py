"""Constant tables inside a plan.

A table of a few hundred entries built from single literal columns costs thousands of calls into the JVM per plan;
as one SQL expression it is parsed once and folded to a literal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: object) -> str:
    """SQL text of strings, numbers, flags, lists and (ordered) mappings as structs. An empty list is of strings."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, Mapping):
        return "named_struct(" + ", ".join(f"'{k}', {sql_text(v)}" for k, v in value.items()) + ")"
    if isinstance(value, Sequence):
        return "array(" + ", ".join(sql_text(v) for v in value) + ")" if value else "cast(array() AS array<string>)"
    raise TypeError(f"no literal for {type(value).__name__}")


def constant(value: object) -> Column:
    return F.expr(sql_text(value))
