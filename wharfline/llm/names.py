"""Names for columns beside those that a caller brings along."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many ``_`` behind it as make it a new one.

    Letter case doesn't tell names apart, as in Spark's default. Operators that
    carry columns name what they add, and what they need in between, by this: a
    caller's column always keeps its name, type and values.
    """
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as SQL and ``col`` take it, dots and marks included."""
    return "`" + name.replace("`", "``") + "`"


def map_carrying(docs: DataFrame, carried: list[str], inputs: list[Column], run: Callable, added: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` over ``docs`` with ``carried`` columns under any names.

    ``run`` gets batches of the carried columns, called c0, c1 and so on, and of
    the inputs, called i0, i1; it gives the carried ones and then the added ones.
    """
    named = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(carried)]
    schema = T.StructType([*(T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(carried)), *(T.StructField(f"a{k}", f.dataType) for k, f in enumerate(added))])
    mapped = docs.select(*named, *[c.alias(f"i{k}") for k, c in enumerate(inputs)]).mapInArrow(run, schema)
    return mapped.toDF(*carried, *[f.name for f in added])
