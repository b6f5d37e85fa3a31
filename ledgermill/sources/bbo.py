"""Best-bid-and-offer replays as text: `timestamp_ns,market_id,best_bid,best_ask,bid_depth,ask_depth` in integers.

Blank lines, lines that start with # and a header are skipped. Rows that break a rule keep their text and name the
first rule they break: fields, negative, crossed, tick, order (a time before the market's last).
"""
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ("timestamp_ns", "market_id", "best_bid_raw", "best_ask_raw", "bid_depth_raw", "ask_depth_raw")


def parse(lines: DataFrame, tick=1_000_000) -> DataFrame:
    """Rows of (line, value) to typed columns and `error` (null where all holds)."""
    text = F.trim("value")
    rows = lines.filter((F.length(text) > 0) & ~text.startswith("#") & ~F.lower(text).startswith("timestamp_ns"))
    parts = F.split(text, ",")
    whole = F.size(parts) == len(NAMES)
    rows = rows.withColumn("parts", F.transform(parts, lambda p: F.when(F.trim(p).rlike("^-?[0-9]{1,18}$"), F.trim(p).cast("long"))))
    rows = rows.select("line", "value", *[F.when(whole, F.get("parts", F.lit(i))).alias(n) for i, n in enumerate(NAMES)])
    bid, ask = F.col("best_bid_raw"), F.col("best_ask_raw")
    bad = F.when(F.greatest(*[F.col(n).isNull().cast("int") for n in NAMES]) == 1, "fields").when(F.least(*NAMES) < 0, "negative")
    bad = bad.when((bid > 0) & (ask > 0) & (bid >= ask), "crossed").when((bid % tick != 0) | (ask % tick != 0), "tick")
    latest = F.max("timestamp_ns").over(Window.partitionBy("market_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("error", bad.when(F.col("timestamp_ns") < latest, "order"))


def read(spark: SparkSession, path: str, tick=1_000_000) -> DataFrame:
    return parse(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()), tick)
