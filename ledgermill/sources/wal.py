"""A write-ahead log as a Python data source: `spark.read.format("ledger_wal").load(folder)`.

A frame is its length (4 bytes, little end first, all of the frame), protocol version (2), sequence (8), timestamp (8),
command type (2), payload, and the CRC-32 of all before it (4). Files are one partition each. A torn tail at the end of a
file is left out; damage before that stops the read, or in mode `permissive` gives a row with `corrupt` set and ends the file.
"""
import os
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = struct.Struct("<IHQQH")
MOST = 1 << 24
SCHEMA = "protocol_version int, sequence long, timestamp long, command_type int, payload binary, corrupt string"


def encode(version, sequence, timestamp, kind, payload: bytes) -> bytes:
    body = HEAD.pack(HEAD.size + len(payload) + 4, version, sequence, timestamp, kind) + payload
    return body + struct.pack("<I", zlib.crc32(body))


def decode(data: bytes, most=MOST):
    """(rows, error or None, bytes read); an unfinished last frame is no error."""
    rows, at = [], 0
    while at < len(data):
        if len(data) - at < 4:
            return rows, None, at
        size = int.from_bytes(data[at:at + 4], "little")
        if size < HEAD.size + 4 or size > most:
            return rows, "length", at
        if at + size > len(data):
            return rows, None, at
        frame = data[at:at + size]
        if zlib.crc32(frame[:-4]) != int.from_bytes(frame[-4:], "little"):
            return rows, "crc", at
        _, version, sequence, timestamp, kind = HEAD.unpack(frame[:HEAD.size])
        if rows and sequence <= rows[-1][1]:
            return rows, "sequence", at
        rows.append((version, sequence, timestamp, kind, frame[HEAD.size:-4]))
        at += size
    return rows, None, at


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "ledger_wal"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WalReader(self.options)


class WalReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "failfast").lower()

    def partitions(self):
        names = sorted(os.listdir(self.path)) if os.path.isdir(self.path) else [""]
        return [InputPartition(os.path.join(self.path, n) if n else self.path) for n in names if not n.startswith((".", "_"))]

    def read(self, partition):
        with open(partition.value, "rb") as file:
            rows, error, at = decode(file.read())
        if error and self.mode != "permissive":
            raise ValueError(f"{partition.value}: {error} at byte {at}")
        for row in rows:
            yield (*row, None)
        if error:
            yield (None, None, None, None, None, f"{error} at byte {at}")


def register(spark: SparkSession):
    spark.dataSource.register(WalSource)


def find(log: DataFrame, sequence: int) -> DataFrame:
    return log.filter(F.col("sequence") == sequence)


def truncate_after(log: DataFrame, keep_through: int) -> DataFrame:
    return log.filter(F.col("sequence") <= keep_through)


def replay(log: DataFrame, start, step, after=None):
    """Fold of the records behind a snapshot's last sequence, in order; returns (state, last sequence, error).

    Records come in order through an iterator, so the driver holds one partition at a time. At the first error the fold stops.
    """
    last, state = after, start
    rows = log if after is None else log.filter(F.col("sequence") > after)
    for row in rows.orderBy("sequence").toLocalIterator():
        try:
            state = step(state, row)
        except Exception as error:  # the step's own failure is the result
            return state, last, (row.sequence, str(error))
        last = row.sequence
    return state, last, None


def append(log: DataFrame, folder: str, last=None):
    """Adds records as Parquet; a sequence that does not rise above the last one is refused."""
    least, n, many = log.agg(F.min("sequence"), F.count("*"), F.count_distinct("sequence")).first()
    if n and (n != many or (last is not None and least <= last)):
        raise ValueError("sequences must rise")
    log.repartitionByRange("sequence").sortWithinPartitions("sequence").write.mode("append").parquet(folder)
