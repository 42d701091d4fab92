"""Flat views of nested events: dotted columns, the keys of JSON texts, offsets of units in a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators.jsontext import read


def flat_columns(df: DataFrame) -> DataFrame:
    """Every leaf of nested structs as a column with its dotted name."""
    found: list[Column] = []

    def walk(fields: T.StructType, path: tuple[str, ...]) -> None:
        for f in fields:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in at)).alias(".".join(at)))

    walk(df.schema, ())
    return df.select(*found)


def json_keys(text: Column) -> Column:
    """The dotted keys of the objects in a JSON text, sorted; inner objects' keys and those that hold them.  Empty where the text is no object."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def keys(text: str | None) -> list[str]:
            found, waiting = [], [("", read(text))]
            while waiting:
                path, value = waiting.pop()
                if isinstance(value, dict):
                    for k, v in value.items():
                        found.append(f"{path}{k}")
                        waiting.append((f"{path}{k}.", v))
            return sorted(found)

        return texts.map(keys)

    return run(text)


def unit_offsets(text: Column, units: Column) -> Column:
    """Where each unit begins (from 0), each looked for after the end of the one before."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, unit: Column) -> Column:
        # a unit that isn't there takes the place reached
        place = F.call_function("locate", unit, text, state["at"])
        here = F.when(place > 0, place).otherwise(state["at"])
        after = F.when(place > 0, place + F.length(unit)).otherwise(state["at"])
        return F.struct(after.cast("int").alias("at"), F.concat(state["found"], F.array((here - 1).cast("int"))).alias("found"))

    return F.aggregate(units, start, step, lambda s: s["found"])


def like(x: Column, pattern: str) -> Column:
    """Wildcards * and ? (case matters), everything else literal."""
    literal = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or ord(c) > 127 or c.isspace() else "\\" + c for c in pattern)
    return x.rlike(f"(?s)^{literal}$")
