"""Metrics as lines of `name value`, and reports as JSON of a stated schema."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_text(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.concat_ws(" ", "name", F.col("value").cast("string")).alias("line"))


def from_text(lines: DataFrame) -> DataFrame:
    """name, value; comments, blank lines and lines of another form are left out."""
    parts = F.split(F.trim("line"), r"\s+")
    good = (F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike("^-?[0-9]{1,38}$") & ~F.trim("line").startswith("#")
    return lines.filter(good).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).cast("decimal(38,0)").alias("value"))


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
