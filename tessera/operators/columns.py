"""Operators on the columns of records: keep, rename, merge, check. What isn't there is left out in silence only by `keep`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def keep(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns that exist."""
    return df.select(*(c for c in names if c in df.columns))


def rekey(df: DataFrame, mapping: dict[str, str], keep_old: bool = False) -> DataFrame:
    """New columns from old ones; one old column may feed several. Old ones go unless keep_old."""
    old = set(mapping.values())
    rest = [c for c in df.columns if c not in mapping and (keep_old or c not in old)]
    return df.select(*rest, *(F.col(o).alias(n) for n, o in mapping.items()))


def rename_or_drop(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Only mapped columns stay: new name from old name; a new name without an old one is dropped."""
    return df.select(*(F.col(o).alias(n) for n, o in mapping.items() if o is not None))


def inputs_and_targets(df: DataFrame, column: str) -> DataFrame:
    """Both columns of a language-model row, from one."""
    return df.select(F.col(column).alias("inputs"), F.col(column).alias("targets"))


def merged(columns: list[Column], most: int = 0) -> Column:
    """Scalars and lists put into one list, nulls left out; at most `most` elements, if that is positive. The first column
    tells nothing of the others' shape: pass lists as arrays, scalars in `array`."""
    out = F.filter(F.flatten(F.array(*columns)), lambda x: x.isNotNull())
    return F.slice(out, 1, most) if most > 0 else out


def first_text(x: Column) -> Column:
    """Text of a one-element list of bytes."""
    return F.decode(F.get(x, F.lit(0)), "UTF-8")


def reshaped_packing(df: DataFrame, names: list[str]) -> DataFrame:
    """A struct of (values, segments, positions) for each name becomes three columns."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, *(F.col(f"{n}.{part}").alias(n + ending) for n in names for part, ending in (("values", ""), ("segments", "_segmentation"), ("positions", "_position"))))


def is_conversational(schema: StructType, columns: list[str]) -> bool:
    """Whether one of the columns is a list of messages with role and content."""
    for name in columns:
        kind = schema[name].dataType if name in schema.names else None
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {"role", "content"} <= set(kind.elementType.names):
            return True
    return False


KNOWN_SHAPES = ({"prompt", "completion"}, {"messages"}, {"question", "answer"})  # fixed values: column sets of instruction data


def check_shape(columns: list[str], allowed: tuple[set[str], ...] = KNOWN_SHAPES) -> set[str]:
    """The column set, if it is one of the allowed ones; else a ValueError."""
    if set(columns) not in allowed:
        raise ValueError(f"columns {sorted(columns)} are none of {[sorted(a) for a in allowed]}")
    return set(columns)


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """df, if no key occurs twice; else a ValueError."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} occurs more than once")
    return df


def checked_length(x: Column, most: int) -> Column:
    """The array, if it isn't longer than `most`; else the query fails."""
    return F.when(F.size(x) <= most, x).otherwise(F.raise_error(F.concat(F.lit("prompt of "), F.size(x).cast("string"), F.lit(f" tokens, over {most}"))))
