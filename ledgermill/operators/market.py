"""Market queries over integer fixed-point columns derived from the star schema."""

from ledgermill.plans import sql

FILLS = """select l_partkey % 64 as market_id, o_custkey as taker, 1000000 + l_suppkey as maker,
  cast(floor(l_quantity) as bigint) as lots,
  cast(floor(l_extendedprice * 100 + 0.5) as bigint) as cents,
  case when l_linestatus = 'O' then 'bid' else 'ask' end as taker_side, l_orderkey as order_id, l_shipdate as at
  from lineitem join orders on l_orderkey = o_orderkey"""

# A fill has two sides; the join with the two signs reads it once.
SIDES = "(select 1 as sign union all select -1) s"

#: Name to SQL that reads the same in Spark and the oracle.
SQL = {
    "fills_by_market": f"select market_id, taker_side, count(*) as n_fills, cast(sum(lots) as bigint) as lots, cast(sum(cents) as bigint) as notional_cents from ({FILLS}) f group by market_id, taker_side",
    "net_positions": f"select account, market_id, cast(sum(lots) as bigint) as net_lots, count(*) as n_fills from (select case when sign = 1 then taker else maker end as account, market_id, case when taker_side = 'bid' then sign * lots else -sign * lots end as lots from ({FILLS}) f cross join {SIDES}) x group by account, market_id",
    "notional_conservation": f"select market_id, cast(sum(case when taker_side = 'bid' then cents else -cents end) as bigint) as taker_flow, cast(sum(case when taker_side = 'bid' then -cents else cents end) as bigint) as maker_flow from ({FILLS}) f group by market_id",
    "top_markets": f"select market_id, cast(sum(cents) as bigint) as notional_cents from ({FILLS}) f group by market_id order by notional_cents desc, market_id limit 10",
    "depth_levels": f"select market_id, taker_side as side, price, cast(sum(lots) as bigint) as lots, count(*) as n_orders from (select *, cast(floor(cents / (lots * 100)) as bigint) as price from ({FILLS}) f where lots > 0) p group by market_id, taker_side, price",
    "sequence_gaps": "select user_id, event_id, event_id - prev - 1 as gap from (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) as prev from events) e where event_id - prev > 1",
    "duplicate_keys": "select l_orderkey as order_id, l_linenumber as line_no, count(*) as n_rows from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
    "event_value_ranks": """with counted as (select event_type, cents, count(*) as m from (select event_type, cast(floor(value * 100 + 0.5) as bigint) as cents from events) e group by event_type, cents),
  cum as (select event_type, cents, sum(m) over (partition by event_type order by cents rows unbounded preceding) as c, sum(m) over (partition by event_type) as n from counted)
  select event_type, cast(max(n) as bigint) as n, min(case when 2 * c >= n then cents end) as p50, min(case when 100 * c >= 99 * n then cents end) as p99, max(cents) as top from cum group by event_type""",
    "maker_taker_accounts": f"select account, cast(sum(is_taker) as bigint) as n_taker, cast(sum(1 - is_taker) as bigint) as n_maker from (select case when sign = 1 then taker else maker end as account, case when sign = 1 then 1 else 0 end as is_taker from ({FILLS}) f cross join {SIDES}) x group by account",
    "under_collateralized": "select c_custkey as account, cast(floor(c_acctbal * 100 + 0.5) as bigint) as collateral_cents from customer where c_acctbal < 0",
}
QUERIES = sql.queries(SQL)


def query(name):
    return QUERIES[name]
