"""Event streams: sequence tracking by keyed state, late data by watermarks, duplicates within a watermark.

Streams read the event table as files, run over what is there and write to a folder that the cluster shares.
"""
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode="append") -> DataFrame:
    """What a stream makes of all that is there."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"{shared or tempfile.mkdtemp(prefix='stream')}/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").format("parquet").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _track(key, batches, state):
    """Verdict of each sequence of a topic in order of arrival: apply, duplicate or gap; the state is the last one applied."""
    last = state.get[0] if state.exists else None
    for pdf in batches:
        verdicts = []
        for sequence in pdf["sequence"].tolist():
            if last is None or sequence == last + 1:
                verdicts.append("apply")
                last = sequence
            else:
                verdicts.append("duplicate" if sequence <= last else "gap")
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"topic": key[0], "sequence": pdf["sequence"], "verdict": verdicts})


def track(rows: DataFrame) -> DataFrame:
    """topic, sequence, verdict; after a gap the stream waits for the sequence that is missing."""
    return rows.groupBy("topic").applyInPandasWithState(_track, "topic long, sequence long, verdict string", "last long", "append", GroupStateTimeout.NoTimeout)


def tracked(spark, sf_dir):
    rows = source(spark, sf_dir).select((F.col("user_id") % 4).alias("topic"), F.expr("event_id div 4").alias("sequence"))
    return drained(track(rows))


def windowed(spark, sf_dir):
    """Events and micro-units of each closed hour and kind; what comes later than an hour behind the newest is left out."""
    rows = source(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    micros = F.floor(F.col("value") * 1000000 + 0.5).cast("long")
    out = rows.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(micros).alias("total_raw"))
    return drained(out.select(F.unix_micros("window.start").alias("from_us"), "event_type", "n", "total_raw"))


def deduplicated(spark, sf_dir):
    """The users and kinds that a stream lets through once within a year's watermark."""
    rows = source(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "365 days")
    return drained(rows.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


QUERIES = {"stream_sequence_tracker": tracked, "stream_windows": windowed, "stream_deduplicated": deduplicated}
SQL = {"stream_deduplicated": "select distinct user_id, event_type from events"}


def query(name):
    return QUERIES[name]
