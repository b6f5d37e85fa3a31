"""Round trips of packed orders and conditional records as queries."""
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ledgermill.functions.hashing import little
from ledgermill.operators.derivatives import TICKS
from ledgermill.plans import sql
from ledgermill.sources import packets

# Batches of 64 records of a market; the last of a market may be too short for a batch. A few records break a rule.
_ORDERS = f"""with {TICKS}, numbered as (select *, row_number() over (partition by market_id order by event_id) - 1 as r from ticks)
select cast(market_id * 1000000 + r @/ 64 as bigint) as batch, cast(r % 64 as int) as idx, case event_id % 3 when 0 then 'submit' when 1 then 'cancel' else 'replace' end as action, cast(user_id % 1000 as bigint) as session,
  cast(event_id as bigint) as nonce, cast(user_id as bigint) as client, cast(user_id as bigint) as account, cast(market_id as bigint) as market_id, case when event_id % 2 = 0 then 'bid' else 'ask' end as side,
  case event_id % 4 when 0 then 'limit' when 1 then 'market' when 2 then 'post_only' else 'reduce_only' end as kind, case event_id % 5 when 0 then 'ioc' when 1 then 'fok' else 'gtc' end as life,
  cast(event_id + 1 as bigint) as order_id, cast(case when event_id % 997 = 0 then -price_raw else price_raw + 1 end as bigint) as price_raw, cast(user_id + 1 as bigint) as qty_raw, cast(1000000 as bigint) as leverage_raw from numbered"""
_KEEP = "batch, idx, action, session, cast(nonce as bigint) as nonce, cast(client as bigint) as client, account, market_id, side, kind, life, cast(order_id as bigint) as order_id, price_raw, qty_raw, leverage_raw"
_STOPS = f"""with {TICKS} select cast(event_id as bigint) as event_id, cast(user_id as bigint) as account, cast(event_id % 3 as bigint) as side, cast(event_id % 5 as bigint) as kind, cast(event_id % 7 % 4 as bigint) as life, cast(event_id % 2 as bigint) as trigger_code,
  cast(price_raw as bigint) as price_raw, cast(event_id % 11 - 1 as bigint) as qty_raw, cast(-price_raw as bigint) as threshold_raw, cast(event_id * 3 as bigint) as client, cast(event_id % 13 % 2 + case when event_id % 50 = 0 then 2 else 0 end as bigint) as reduce_code from ticks"""


def _batches(spark, sf_dir):
    return packets.batches(sql.run(spark, sf_dir, _ORDERS), "batch")


def _records(spark, sf_dir):
    return packets.decoded(_batches(spark, sf_dir), "batch").filter("verdict is null").selectExpr(*_KEEP.split(", "))


@pandas_udf(BinaryType())
def sealed(data, n):
    return data.combine(n, lambda d, k: packets.seal(bytes(d), int(k)))


def _envelopes(spark, sf_dir):
    return packets.decoded(_batches(spark, sf_dir).withColumn("data", sealed("data", "n")), "batch", sealed=True).filter("verdict is null").selectExpr(*_KEEP.split(", "))


def _verdicts(spark, sf_dir):
    return packets.decoded(_batches(spark, sf_dir), "batch").groupBy("batch", "verdict").agg(F.count("idx").alias("n_records"))


def _stops(spark, sf_dir):
    c = F.col
    data = F.unhex(F.concat(little(c("account"), 4), *[little(c(x), 1) for x in ("side", "kind", "life", "trigger_code")], *[little(c(x)) for x in ("price_raw", "qty_raw", "threshold_raw", "client")], little(c("reduce_code"), 1)))
    read = sql.run(spark, sf_dir, _STOPS).select("event_id", packets.conditional(data).alias("r"))
    return read.select("event_id", "r.verdict", *[F.when(F.col("r.verdict") == "ok", F.col(f"r.{x}")).alias(x) for x in ("account", "side", "kind", "life", "trigger", "price_raw", "qty_raw", "threshold_raw", "client", "reduce_only")])


QUERIES = {"packed_orders": _records, "packed_verdicts": _verdicts, "sealed_orders": _envelopes, "conditional_decode": _stops}

# A batch that breaks a rule yields nothing; fields that a kind of record does not carry are null.
_JUDGED = sql.render("with o as (" + _ORDERS + ")", "oracle") + """, judged as (select batch, count(*) as n, coalesce(min(case when action = 'submit' and kind <> 'market' and price_raw <= 0 or action = 'replace' and price_raw <= 0 then 1 end), 0) as bad from o group by batch)"""
_FIELDS = """o.batch, idx, action, session, nonce, client, account, market_id, case when action = 'submit' then side end as side, case when action = 'submit' then kind end as kind, case when action = 'submit' then life end as life,
  case when action <> 'submit' then order_id end as order_id, case when action <> 'cancel' then price_raw end as price_raw, case when action <> 'cancel' then qty_raw end as qty_raw, case when action = 'submit' then leverage_raw end as leverage_raw"""
SQL = {
    "packed_orders": f"{_JUDGED} select {_FIELDS} from o join judged on judged.batch = o.batch where n >= 32 and bad = 0",
    "sealed_orders": f"{_JUDGED} select {_FIELDS} from o join judged on judged.batch = o.batch where bad = 0",
    "packed_verdicts": f"{_JUDGED} select batch, case when n < 32 then 'size' when bad = 1 then 'value' end as verdict, case when n < 32 or bad = 1 then 0 else n end as n_records from judged",
    "conditional_decode": sql.render("with s as (" + _STOPS + ")", "oracle") + """, v as (select *, case when side > 1 or kind > 3 or life > 2 then 'malformed' when qty_raw <= 0 then 'quantity' when reduce_code > 1 then 'malformed' else 'ok' end as verdict from s)
select event_id, verdict, case when verdict = 'ok' then account end as account, case when verdict = 'ok' then ['bid', 'ask'][side + 1] end as side, case when verdict = 'ok' then ['limit', 'market', 'post_only', 'reduce_only'][kind + 1] end as kind,
  case when verdict = 'ok' then ['gtc', 'ioc', 'fok'][life + 1] end as life, case when verdict = 'ok' then ['above', 'below'][trigger_code + 1] end as trigger, case when verdict = 'ok' then price_raw end as price_raw, case when verdict = 'ok' then qty_raw end as qty_raw,
  case when verdict = 'ok' then threshold_raw end as threshold_raw, case when verdict = 'ok' then client end as client, case when verdict = 'ok' then reduce_code = 1 end as reduce_only from v""",
}
