"""Small results as compact text: a table's constant columns stand once above it, and nothing is left out of lists."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Fields that carry no evidence.
LEFT_OUT = ("dataset", "metric", "unit", "source")


def cell(value: Any) -> str:
    """Numbers to four places at most, everything else as JSON without quotes."""
    if isinstance(value, float):
        return "null" if pd.isna(value) else f"{round(value, 4):g}" if abs(value) < 1e5 else repr(round(value, 4))
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def constant_columns(frame: pd.DataFrame) -> list[str]:
    """Of a frame of texts with two rows or more, the columns of one value."""
    return [c for c in frame.columns if len(frame) > 1 and frame[c].nunique() == 1]


def constants(rows: DataFrame) -> DataFrame:
    """(name, value as text) of the columns of a table that hold one value, or null alone, in two rows or more; lists, maps and records are none. One aggregate, whatever the size."""
    n, facts = F.count("*"), []
    for field in rows.schema.fields:
        if not isinstance(field.dataType, (ArrayType, MapType, StructType)):
            c = F.col(f"`{field.name}`")
            same = (F.count(c) == 0) | ((F.count(c) == n) & (F.min(c) == F.max(c)))
            facts.append(F.when((n > 1) & same, F.struct(F.lit(field.name).alias("name"), F.min(c).cast("string").alias("value"))))
    found = F.array_compact(F.array(*facts)) if facts else F.array().cast("array<struct<name:string,value:string>>")
    return rows.agg(found.alias("found")).select(F.inline("found"))


def table(name: str, rows: list[dict[str, Any]]) -> str:
    frame = pd.DataFrame([{k: cell(v) for k, v in r.items()} for r in rows]).fillna("null")
    fixed = constant_columns(frame)
    head = "; ".join([f"{name}: {len(frame)} rows", *(f"{c} = {frame[c].iloc[0]}" for c in fixed)])
    rest = frame.drop(columns=fixed)
    return head if rest.empty or not len(rest.columns) else head + "\n" + rest.to_csv(sep="\t", index=False, quoting=3, escapechar="\\").rstrip("\n")


def payload(result: dict[str, Any]) -> str:
    """Single values on one line, each list of records as a table below."""
    kept = {k: v for k, v in result.items() if k not in LEFT_OUT}
    tables = [k for k, v in kept.items() if isinstance(v, list) and v and all(isinstance(r, dict) for r in v)]
    line = "; ".join(f"{k} = {cell(v)}" for k, v in kept.items() if k not in tables)
    return "\n".join([*([line] if line else []), *(table(k, kept[k]) for k in tables)])
