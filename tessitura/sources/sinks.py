"""Writers: JSON lines, TSV tables (partitioned by a column instead of a file for each author), Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def tsv(df: DataFrame, path: str, by: list[str] | None = None, formats: dict[str, int] | None = None) -> None:
    """formats: decimals of double columns. Null is the empty string; arrays are joined by a space."""
    shown = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name in (formats or {}):
            c = F.format_string(f"%.{formats[f.name]}f", c)
        elif f.dataType.typeName() == "array":
            c = F.array_join(c, " ")
        shown.append(c.alias(f.name))
    writer = df.select(*shown).write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").option("quote", '"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
