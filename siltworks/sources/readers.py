"""Tables and files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Headers of columns that only number the rows.
INDEX_HEADERS = ["序号", "编号", "no", "no.", "index", "#"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", schema: StructType | None = None) -> DataFrame:
    """A sheet with a header row: blank cells become null, short rows are padded, row-number columns go."""
    reader = spark.read.options(header=True, multiLine=True, encoding=encoding, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    sheet = (reader.schema(schema) if schema else reader).csv(path)
    kept = [f for f in sheet.schema.fields if f.name.strip().lower() not in INDEX_HEADERS]
    return sheet.select(*[F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in kept])


def read_json(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """Rows of a top-level list, of the list under ``wrapper``, or one object; nested cells as JSON text."""
    rows = spark.read.option("multiLine", True).json(path)
    if wrapper:
        rows = rows.select(F.explode_outer(F.col(f"`{wrapper}`")).alias("row")).select("row.*")
    nested = lambda f: f.dataType.typeName() in ("struct", "array", "map")
    return rows.select(*[(F.to_json(F.col(f"`{f.name}`")) if nested(f) else F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema.fields])


def fill_down(value: Column, order: str, *keys: str) -> Column:
    """The last value that isn't null, as merged cells show it."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def replace_partition(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` with the rows of every key that ``new`` has replaced by those of ``new``."""
    return held.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
