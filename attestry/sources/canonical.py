"""The canonical text form of a table: a header of descriptors, then a JSON array per row in total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import header_line, row_line
from ..types import Numeric, TableSchema, Temporal


def lines(positioned: DataFrame, schema: TableSchema) -> DataFrame:
    """``pos, line`` of a positioned result."""
    return positioned.select("pos", row_line(schema).alias("line"))


def write(positioned: DataFrame, schema: TableSchema, path: str) -> None:
    """One canonical file; for results of a bounded size."""
    spark = positioned.sparkSession
    head = spark.createDataFrame([(0, header_line(schema))], "pos long, line string")
    head.unionByName(lines(positioned, schema)).coalesce(1).sortWithinPartitions("pos").select("line").write.text(path)


def parse(rows: DataFrame, schema: TableSchema) -> DataFrame:
    """``pos, line`` back to typed columns, with ``faithful``: whether a row's text is what its cells render to."""
    cells = F.from_json("line", "array<string>")
    typed = rows.select("pos", "line", *[_typed(cells[i], c).alias(c.name) for i, c in enumerate(schema.columns)])
    return typed.withColumn("faithful", F.coalesce(row_line(schema) == F.col("line"), F.lit(False)))


def _typed(c, column):
    if isinstance(column, Numeric):
        return c.try_cast(f"decimal(38,{column.scale})")
    if isinstance(column, Temporal):
        return c.try_cast("date" if column.granularity == "date" else "timestamp_ntz")
    return c


def read(spark: SparkSession, path: str, schema: TableSchema) -> DataFrame:
    """A canonical file's rows; the header must be the schema's."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("ls"))
    body = text.select(F.col("ls")[0].alias("head"), F.posexplode(F.slice("ls", 2, 2**31 - 1)).alias("at", "line")).filter("line <> ''")
    return parse(body.filter(F.col("head") == header_line(schema)).select((F.col("at") + 1).cast("long").alias("pos"), "line"), schema)


def chart_rows(positioned: DataFrame, schema: TableSchema) -> DataFrame:
    """``pos, row``: rows as JSON objects in position order, decimals as number tokens at their scale."""
    return positioned.select("pos", F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"}).alias("row"))
