"""Helpers shared by the training-data operators."""
import hashlib
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> list:
    """ASCII-lower-cased words as bytes; None has none."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only in a single process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def keep_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows for whose text judge() holds, each judged by itself; columns pass through as Arrow, of any type, unchanged."""
    def run(batches):
        keep = judge()
        for batch in batches:
            yield batch.filter(pa.array([bool(keep(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# Types of computed columns.
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def add_columns(df: DataFrame, kept, read, tail: str, make) -> DataFrame:
    """Columns `kept` as they are, with those of `tail` made by make() from lists of the columns `read`.

    Arrow passes the kept columns through untouched: pandas would turn a long with a null among its values into a double.
    """
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    fields = [f.split() for f in tail.split(", ")]
    names = [*kept, *[f[0] for f in fields]]

    def run(batches):
        f = make()
        for batch in batches:
            columns = f(*[batch.column(c).to_pylist() for c in read])
            made = [pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names)

    return df.mapInArrow(run, f"{head}, {tail}")


def columns_of(rows, width: int) -> list:
    """Columns of rows, also of none."""
    return [list(c) for c in zip(*rows)] or [[] for _ in range(width)]


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, most=10_000) -> DataFrame:
    """Inner join where `right` has one row for each key and a column `n`, the key's rows in `left`.

    Keys above total / most rows are at most `most` in number, so they are broadcast and their rows stay
    where they are; no shuffled key then has more than that share. `n` is dropped.
    """
    bound = max(total // most, 1000)
    heavy = right.filter(F.col("n") > bound).drop("n")
    light = right.filter(F.col("n") <= bound).drop("n")
    names = [c for c in right.columns if c not in (key, "n")]
    first = left.join(F.broadcast(heavy.withColumn("is_hot", F.lit(True))), key, "left")
    done = first.filter("is_hot").select(*left.columns, *names)
    rest = first.filter("is_hot is null").select(*left.columns).join(light, key).select(*left.columns, *names)
    return done.unionByName(rest)


def fold(column: str, modulus: int):
    """crc32 of the id as text, mod the number of folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
