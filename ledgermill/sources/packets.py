"""Packed orders: fixed little-endian records, batches of them, and checked envelopes of batches.

A record is a head (version, tag, length, flags, session), nonce, client, account and market, then three words
(submit: price, quantity, leverage; replace: order, price, quantity) or one (cancel: order). A batch holds 32 to 128
records and nothing else. An envelope adds a head with lengths and CRC-32, and an LZ4 block where that is shorter;
partial ones hold 1 to 31 records. Reading is all or nothing: the first rule that is broken names the verdict.
"""
import struct
import zlib
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ledgermill.functions.hashing import little

# Fixed values of the formats.
VERSION, TAGS, SIZES = 1, {"submit": 1, "cancel": 2, "replace": 3}, {1: 56, 2: 40, 3: 56}
SIDES, KINDS, LIVES = ("bid", "ask"), ("limit", "market", "post_only", "reduce_only"), ("gtc", "ioc", "fok")
MAGIC, HEAD, MOST, RAW, PARTIAL, PLAIN, LZ4 = 0xB417, struct.Struct("<HBBBBHIII"), 64 * 1024, 1, 2, 0, 1
CONDITIONAL = 41

FIELDS = "idx int, action string, session long, nonce decimal(20,0), client decimal(20,0), account long, market_id long, side string, kind string, life string, order_id decimal(20,0), price_raw long, qty_raw long, leverage_raw long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def code(column: Column, names) -> Column:
    """Place of a name in a fixed list."""
    out = F.when(column == names[0], 0)
    for i, name in enumerate(names[1:], 1):
        out = out.when(column == name, i)
    return out


def record() -> Column:
    """Hex of a row's record, by columns named as in FIELDS; native functions only."""
    submit, cancel = F.col("action") == "submit", F.col("action") == "cancel"
    tag = F.when(submit, 1).when(cancel, 2).otherwise(3)
    flags = F.when(submit, code(F.col("side"), SIDES) + 2 * code(F.col("kind"), KINDS) + 8 * code(F.col("life"), LIVES)).otherwise(0)
    head = [little(F.lit(VERSION), 1), little(tag, 1), little(F.when(cancel, SIZES[2]).otherwise(SIZES[1]), 1), little(flags, 1), little(F.col("session"), 4)]
    body = F.when(submit, F.concat(*[little(F.col(c)) for c in ("price_raw", "qty_raw", "leverage_raw")])).when(cancel, little(F.col("order_id")))
    body = body.otherwise(F.concat(*[little(F.col(c)) for c in ("order_id", "price_raw", "qty_raw")]))
    return F.concat(*head, little(F.col("nonce")), little(F.col("client")), little(F.col("account"), 4), little(F.col("market_id"), 4), body)


def batches(rows: DataFrame, key: str) -> DataFrame:
    """key, n, data: the records of each key in order of nonce; a key is a batch, so callers bound it."""
    packed = rows.select(key, F.struct("nonce", record().alias("hex")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return packed.select(key, F.size("rs").alias("n"), F.unhex(F.array_join(F.col("rs.hex"), "")).alias("data"))


def read_record(data: bytes, at: int):
    """(verdict, fields, length); the verdict is None for a good record."""
    if len(data) - at < 4:
        return "truncated", None, 0
    version, tag, length, flags = data[at:at + 4]
    if version != VERSION:
        return "version", None, 0
    if tag not in SIZES:
        return "tag", None, 0
    if length != SIZES[tag]:
        return "length", None, 0
    if len(data) - at < length:
        return "truncated", None, 0
    session, nonce, client, account, market = struct.unpack_from("<IQQII", data, at + 4)
    side = kind = life = order = price = qty = leverage = None
    if tag == 1:
        if flags >> 5:
            return "reserved", None, 0
        if flags >> 3 >= len(LIVES):
            return "value", None, 0
        side, kind, life = SIDES[flags & 1], KINDS[flags >> 1 & 3], LIVES[flags >> 3]
        price, qty, leverage = struct.unpack_from("<qqq", data, at + 32)
        good = qty > 0 and leverage > 0 and (kind == "market" or price > 0)
    elif flags:
        return "reserved", None, 0
    else:
        order = struct.unpack_from("<Q", data, at + 32)[0]
        good = order != 0
        if tag == 3:
            price, qty = struct.unpack_from("<qq", data, at + 40)
            good = good and price > 0 and qty > 0
    if not good:
        return "value", None, 0
    return None, ("submit cancel replace".split()[tag - 1], session, nonce, client, account, market, side, kind, life, order, price, qty, leverage), length


def read_records(data: bytes, count: int):
    """(verdict, rows) of exactly `count` records."""
    at, rows = 0, []
    for i in range(count):
        verdict, fields, length = read_record(data, at)
        if verdict:
            return verdict, []
        rows.append((i, *fields))
        at += length
    return ("trailing", []) if at != len(data) else (None, rows)


def read_batch(data: bytes, count: int):
    return read_records(data, count) if 32 <= count <= 128 else ("size", [])


def lz4_block(data: bytes) -> bytes:
    """An LZ4 block: greedy matches of the latest place with the same four bytes."""
    def run(out, literals, length=None, distance=0):
        low, high = len(literals), 0 if length is None else length - 4
        out.append(min(low, 15) << 4 | min(high, 15))
        if low >= 15:
            out += b"\xff" * ((low - 15) // 255) + bytes([(low - 15) % 255])
        out += literals
        if length is not None:
            out += distance.to_bytes(2, "little")
            if high >= 15:
                out += b"\xff" * ((high - 15) // 255) + bytes([(high - 15) % 255])

    out, seen, start, at = bytearray(), {}, 0, 0
    # A match may not begin in the last 12 bytes nor reach into the last 5.
    while at < len(data) - 12:
        four = data[at:at + 4]
        was = seen.get(four, -1)
        seen[four] = at
        if was < 0 or at - was > 65535:
            at += 1
            continue
        end = at + 4
        while end < len(data) - 5 and data[end] == data[was + end - at]:
            end += 1
        run(out, data[start:at], end - at, at - was)
        start = at = end
    run(out, data[start:])
    return bytes(out)


def lz4_plain(block: bytes, most: int):
    """The bytes of an LZ4 block; None if it is malformed or longer than `most`."""
    out, at = bytearray(), 0

    def more(n, at):
        while n >= 15:
            if at >= len(block):
                return None, at
            n, at, again = n + block[at], at + 1, block[at] == 255
            if not again:
                break
        return n, at

    while at < len(block):
        token = block[at]
        n, at = more(token >> 4, at + 1)
        if n is None or at + n > len(block) or len(out) + n > most:
            return None
        out += block[at:at + n]
        at += n
        if at == len(block):
            # The last sequence is literals alone.
            return bytes(out) if not token & 15 else None
        if at + 2 > len(block):
            return None
        back = int.from_bytes(block[at:at + 2], "little")
        n, at = more(token & 15, at + 2)
        if n is None or not 0 < back <= len(out) or len(out) + n + 4 > most:
            return None
        for _ in range(n + 4):
            out.append(out[-back])
    return None


def seal(data: bytes, count: int) -> bytes:
    """The envelope of a batch's records; fewer than 32 make a partial one."""
    block = lz4_block(data)
    raw = len(block) >= len(data)
    flags = (RAW if raw else 0) | (PARTIAL if count < 32 else 0)
    payload = data if raw else block
    return HEAD.pack(MAGIC, VERSION, flags, PLAIN if raw else LZ4, count, 0, len(data), len(payload), zlib.crc32(data)) + payload


def unseal(envelope: bytes):
    """(verdict, rows)."""
    if len(envelope) < HEAD.size:
        return "truncated", []
    magic, version, flags, backend, count, reserved, size, length, crc = HEAD.unpack_from(envelope)
    raw, partial, payload = bool(flags & RAW), bool(flags & PARTIAL), envelope[HEAD.size:]
    rules = (("magic", magic == MAGIC), ("version", version == VERSION), ("flags", not flags & ~(RAW | PARTIAL)), ("backend", backend in (PLAIN, LZ4)), ("reserved", reserved == 0),
             ("count", 1 <= count < 32 if partial else 32 <= count <= 128), ("size", 0 < size <= MOST), ("truncated", length <= len(payload)), ("trailing", length >= len(payload)),
             ("raw_length", not raw or length == size))
    broken = next((name for name, holds in rules if not holds), None)
    if broken:
        return broken, []
    data = payload if raw else lz4_plain(payload, size)
    if data is None or len(data) != size:
        return "payload", []
    return read_records(data, count) if zlib.crc32(data) == crc else ("crc", [])


def decoded(packed: DataFrame, key: str, sealed=False) -> DataFrame:
    """key, verdict and FIELDS of (key, n, data); a rejected batch is one row with its verdict.

    With `sealed` the data are envelopes, which carry their own count.
    """
    schema = f"{key} {packed.schema[key].dataType.simpleString()}, verdict string, {FIELDS}"
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(parts):
        for part in parts:
            out = []
            for k, n, data in zip(*[part.column(c).to_pylist() for c in (key, "n", "data")]):
                verdict, rows = ("null", []) if data is None else unseal(data) if sealed else read_batch(data, n)
                out += [(k, verdict, *r) for r in rows] if verdict is None else [(k, verdict, *[None] * len(NAMES))]
            columns = list(zip(*out)) or [[] for _ in shape]
            yield pa.RecordBatch.from_arrays([pa.array([None if x is None else Decimal(x) for x in c] if pa.types.is_decimal(f.type) else c, f.type) for c, f in zip(columns, shape)], schema=shape)

    return packed.select(key, "n", "data").mapInArrow(run, schema)


def conditional(data: Column) -> Column:
    """A stop's 41 bytes as a struct of verdict and fields; native functions only.

    The record: account, side, kind, life, trigger, price, quantity, threshold, client, reduce-only.
    """
    text = F.hex(data)
    byte = lambda at: F.conv(F.substring(text, 2 * at + 1, 2), 16, 10).cast("int")
    word = lambda at, size=8: F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.substring(text, 2 * at + 1, 2 * size), F.lit("(..)"), 1)), ""), 16, -10).cast("long")
    ok = lambda at, names: byte(at) < len(names)
    triggers = ("above", "below")
    verdict = (F.when(F.length(data) < CONDITIONAL, "malformed").when(~(ok(4, SIDES) & ok(5, KINDS) & ok(6, LIVES)), "malformed")
               .when(word(16) <= 0, "quantity").when(~((byte(40) < 2) & ok(7, triggers)), "malformed").otherwise("ok"))
    name = lambda at, names: F.get(F.array(*[F.lit(n) for n in names]), byte(at))
    fields = [word(0, 4).alias("account"), name(4, SIDES).alias("side"), name(5, KINDS).alias("kind"), name(6, LIVES).alias("life"), name(7, triggers).alias("trigger"),
              word(8).alias("price_raw"), word(16).alias("qty_raw"), word(24).alias("threshold_raw"), word(32).alias("client"), (byte(40) == 1).alias("reduce_only")]
    return F.struct(verdict.alias("verdict"), *fields)
