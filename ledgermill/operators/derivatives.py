"""Positions, margin, price aggregation, payouts, sequences and statistics in integer SQL.

One text serves both engines but for the position fold: `@/` is division toward zero and `micros(x)` microseconds
since the epoch, WIDE an integer beyond 64 bits; `render` writes them for Spark or the oracle. Doubles become integers once, by floor(x * scale + 0.5).
"""

from ledgermill.plans import sql

FILLS = """fills as (select l_partkey % 64 as market_id, o_custkey as taker, 1000000 + l_suppkey as maker,
  cast(floor(l_quantity) as bigint) as lots, cast(floor(l_quantity) as bigint) * 1000000 as qty_raw,
  (cast(floor(l_extendedprice * 100 + 0.5) as bigint) * 10000) @/ cast(floor(l_quantity) as bigint) as price_raw,
  case when l_linestatus = 'O' then 'bid' else 'ask' end as taker_side, l_orderkey as order_id, l_linenumber as line_no,
  l_returnflag as flag, micros(l_shipdate) as at_us from lineitem join orders on l_orderkey = o_orderkey where l_quantity >= 1)"""
# One scan and one join; each fill becomes its two legs.
LEGS = FILLS + """, sides as (select 1 as sign union all select -1), legs as (select case when sign = 1 then taker else maker end as account, market_id,
  case when taker_side = 'bid' then sign * lots else -sign * lots end as lots, price_raw, at_us, order_id, line_no from fills cross join sides)"""
# The order-dependent position: extending averages the entry, reducing realizes, a flip opens at the fill's price.
# Spark folds the ordered legs of an (account, market) in an aggregate; the oracle goes from leg to leg by recursion.
_FOLD = {
    "spark": """, folded as (select account, market_id, aggregate(array_sort(collect_list(struct(at_us, order_id, line_no, price_raw, lots))),
  named_struct('net', 0L, 'entry', 0L, 'realized', cast(0 as decimal(38,0))), (a, x) -> named_struct('net', a.net + x.lots,
  'entry', case when a.net = 0 then x.price_raw when (a.net > 0) = (x.lots > 0) then (abs(a.net) * a.entry + abs(x.lots) * x.price_raw) div (abs(a.net) + abs(x.lots))
    when a.net + x.lots = 0 then 0L when (a.net + x.lots > 0) <> (a.net > 0) then x.price_raw else a.entry end,
  'realized', cast(a.realized + case when a.net = 0 or (a.net > 0) = (x.lots > 0) then 0L else sign(a.net) * (x.price_raw - a.entry) * least(abs(a.net), abs(x.lots)) end as decimal(38,0)))) as p
  from legs where lots <> 0 group by account, market_id),
positions as (select account, market_id, p.net as net_lots, p.entry as entry_raw, cast(p.realized as bigint) as realized_raw from folded)""",
    "oracle": """, steps as (select account, market_id, lots, price_raw, row_number() over (partition by account, market_id order by at_us, order_id, line_no, price_raw, lots) as n from legs where lots <> 0),
walk as (select account, market_id, n, lots as net, price_raw as entry, 0::hugeint as realized from steps where n = 1
  union all select s.account, s.market_id, s.n, w.net + s.lots,
    case when w.net = 0 then s.price_raw
      when w.net * s.lots > 0 then (abs(w.net) * w.entry + abs(s.lots) * s.price_raw) // (abs(w.net) + abs(s.lots))
      when w.net + s.lots = 0 then 0 when (w.net + s.lots) * w.net < 0 then s.price_raw else w.entry end,
    w.realized + case when w.net * s.lots >= 0 then 0 else (case when w.net > 0 then 1 else -1 end) * (s.price_raw - w.entry) * least(abs(w.net), abs(s.lots)) end
  from walk w join steps s on s.account = w.account and s.market_id = w.market_id and s.n = w.n + 1),
positions as (select account, market_id, net as net_lots, entry as entry_raw, cast(realized as bigint) as realized_raw from walk
  qualify row_number() over (partition by account, market_id order by n desc) = 1)""",
}
POSITIONS = LEGS + """FOLDED,
marks as (select market_id, cast(sum(price_raw * lots) as bigint) @/ cast(sum(lots) as bigint) as mark_raw from fills where flag = 'N' group by market_id)"""
ACCOUNTS = POSITIONS + """, accounts as (select c_custkey as account, cast(floor(c_acctbal * 100 + 0.5) as bigint) * 10000 as collateral_raw from customer
  union all select 1000000 + s_suppkey, cast(floor(s_acctbal * 100 + 0.5) as bigint) * 10000 from supplier),
valued as (select p.account, p.market_id, p.market_id % 8 as risk_group, net_lots, coalesce(mark_raw, entry_raw) as mark_raw, entry_raw
  from positions p left join marks m on p.market_id = m.market_id),
banked as (select account, cast(sum(realized_raw) as bigint) as realized_raw from positions group by account),
risk as (select a.account, a.collateral_raw + coalesce(b.realized_raw, 0) as collateral_raw, coalesce(b.realized_raw, 0) as realized_raw, cast(coalesce(sum(net_lots * (mark_raw - entry_raw)), 0) as bigint) as unrealized_raw,
  cast(coalesce(sum(abs(net_lots) * mark_raw), 0) as bigint) as exposure_raw from accounts a left join banked b on a.account = b.account left join valued v on a.account = v.account group by a.account, a.collateral_raw, b.realized_raw)"""
RESTING = FILLS + """, resting as (select market_id, taker_side as side, price_raw @/ 1000000 * 1000000 as price_raw, lots, taker as account, at_us, order_id, line_no from fills where flag = 'N')"""
RANKED = RESTING + """, ranked as (select *, row_number() over (partition by market_id, side order by case when side = 'ask' then price_raw else -price_raw end, at_us, order_id, line_no, lots, account) as place from resting)"""
PLAN = RANKED + """, plan as (select *, least(lots, greatest(0, 500 - (cast(sum(lots) over (partition by market_id order by place rows unbounded preceding) as bigint) - lots))) as fill from ranked where side = 'ask')"""
TICKS = """ticks as (select event_id, user_id, user_id % 16 as market_id, user_id % 8 as source, event_type, micros(ts) as at_us,
  cast(floor(value * 1000000 + 0.5) as bigint) as price_raw, event_id % 5 as weight from events)"""
NEWEST = TICKS + """, newest as (select market_id, user_id, source, price_raw, weight from (select *, row_number() over (partition by market_id, user_id order by event_id desc, price_raw desc) as r from ticks) t where r = 1)"""
MEDIAN = NEWEST + """, weighed as (select market_id, price_raw, 2 * sum(greatest(weight, 0)) over (partition by market_id order by price_raw, weight, user_id rows unbounded preceding) as cum,
  sum(greatest(weight, 0)) over (partition by market_id) as total, row_number() over (partition by market_id order by price_raw, weight, user_id) as r, count(*) over (partition by market_id) as n from newest),
medians as (select market_id, min(price_raw) as center_raw from weighed where case when total > 0 then cum >= total else r = (n - 1) @/ 2 + 1 end group by market_id)"""
MAD = MEDIAN + """, deviations as (select n.market_id, n.user_id, n.source, n.price_raw, n.weight, center_raw, abs(n.price_raw - center_raw) as off_raw from newest n join medians m on n.market_id = m.market_id),
mads as (select market_id, max(case when r = (n + 1) @/ 2 then off_raw end) as mad_raw from (select market_id, off_raw, row_number() over (partition by market_id order by off_raw, user_id) as r, count(*) over (partition by market_id) as n from deviations) t group by market_id)"""
CLAIMS = LEGS + """, claims as (select account, market_id, market_id % 4 as outcome, cast(sum(abs(lots)) as bigint) as units from legs group by account, market_id)"""
SHARES = CLAIMS + """, shares as (select market_id, account, units, 1000003 * units @/ total as base, (1000003 * units) % total as rest, total,
  cast(sum(units) over (partition by market_id order by account rows unbounded preceding) as bigint) as cum from (select *, cast(sum(units) over (partition by market_id) as bigint) as total from claims) c)"""

_SQL = {
    "fill_notional": f"with {FILLS} select market_id, cast(sum(price_raw * qty_raw @/ 1000000) as bigint) as notional_raw, cast(sum(price_raw * qty_raw @/ 1000000 + case when price_raw * qty_raw % 1000000 > 0 then 1 else 0 end) as bigint) as notional_ceil_raw, max(price_raw) as worst_bid_raw from fills group by market_id",
    "fill_fees": f"with {FILLS} select market_id, cast(sum((price_raw * lots * 5 + 9999) @/ 10000) as bigint) as taker_fee_raw, cast(sum(price_raw * lots * 2 @/ 10000) as bigint) as maker_rebate_raw from fills group by market_id",
    "format_price": f"with {FILLS} select order_id, line_no, price_raw, concat(cast(price_raw @/ 1000000 as string), '.', lpad(cast(price_raw % 1000000 as string), 6, '0')) as price from fills",
    "best_quotes": f"with {RESTING} select market_id, max(case when side = 'bid' then price_raw end) as best_bid_raw, min(case when side = 'ask' then price_raw end) as best_ask_raw, (max(case when side = 'bid' then price_raw end) + min(case when side = 'ask' then price_raw end)) @/ 2 as mid_raw, count(*) as n_resting, cast(sum(lots) as bigint) as total_lots from resting group by market_id",
    "price_time_rank": f"with {RANKED} select market_id, side, price_raw, lots, cast(place as bigint) as place from ranked",
    "book_snapshot": f"with {RESTING} select market_id, side, price_raw, lots, cast(level as bigint) as level from (select *, row_number() over (partition by market_id, side order by case when side = 'ask' then price_raw else -price_raw end) as level from (select market_id, side, price_raw, cast(sum(lots) as bigint) as lots from resting group by market_id, side, price_raw) l) r where level <= 100",
    "depth_plan": f"with {PLAN} select market_id, cast(sum(fill) as bigint) as filled_lots, max(price_raw) as worst_raw, cast(sum(fill * price_raw) as bigint) as notional_raw, count(*) as n_makers from plan where fill > 0 group by market_id",
    "fill_or_kill": f"with {PLAN} select market_id, cast(sum(fill) as bigint) >= 500 as fillable from plan group by market_id",
    "crossing_makers": f"with {RESTING}, best as (select market_id, max(price_raw) as bid_raw from resting where side = 'bid' group by market_id) select r.market_id, count(*) as n_crossing, cast(sum(lots) as bigint) as crossable_lots from resting r join best b on r.market_id = b.market_id and r.price_raw <= b.bid_raw where side = 'ask' group by r.market_id",
    "entry_prices": f"WITHFOLD {POSITIONS} select account, market_id, net_lots, entry_raw, realized_raw from positions",
    "account_equity": f"WITHFOLD {ACCOUNTS} select account, collateral_raw, realized_raw, unrealized_raw, collateral_raw + unrealized_raw as equity_raw, exposure_raw from risk",
    "cross_exposure": f"WITHFOLD {ACCOUNTS} select account, cast(sum(abs(net_raw)) as bigint) as cross_raw from (select account, risk_group, sum(net_lots * mark_raw) as net_raw from valued group by account, risk_group) g group by account",
    "account_margin": f"WITHFOLD {ACCOUNTS} select account, (exposure_raw + 9) @/ 10 as initial_raw, (exposure_raw + 19) @/ 20 as maintenance_raw, collateral_raw + unrealized_raw - (exposure_raw + 9) @/ 10 as free_raw from risk",
    "liquidation_candidates": f"WITHFOLD {ACCOUNTS} select account, collateral_raw + unrealized_raw as equity_raw, (exposure_raw + 19) @/ 20 as maintenance_raw from risk where collateral_raw + unrealized_raw < (exposure_raw + 19) @/ 20",
    "system_value": f"WITHFOLD {ACCOUNTS} select cast(sum(collateral_raw + unrealized_raw) as bigint) as value_raw, count(*) as n_accounts from risk",
    "market_holders": f"WITHFOLD {POSITIONS} select market_id, count(*) as n_holders, cast(sum(abs(net_lots)) as bigint) as open_lots from positions where net_lots <> 0 group by market_id",
    "adl_ranking": f"WITHFOLD {ACCOUNTS} select market_id, account, profit_raw, cast(row_number() over (partition by market_id order by profit_raw desc, account) as bigint) as place from (select market_id, account, net_lots * (mark_raw - entry_raw) as profit_raw from valued where net_lots <> 0) v where profit_raw > 0",
    "touched_accounts": f"with {FILLS} select taker as account from fills union select maker from fills",
    "newest_observations": f"with {NEWEST} select market_id, user_id, price_raw, weight from newest",
    "weighted_median": f"with {MEDIAN} select market_id, center_raw from medians",
    "outlier_filter": f"with {MAD} select d.market_id, d.user_id, d.price_raw, center_raw, mad_raw, mad_raw <> 0 and off_raw > 3 * mad_raw as outlier from deviations d join mads m on d.market_id = m.market_id",
    "kept_weight": f"with {MAD} select d.market_id, cast(sum(weight) as bigint) as kept_weight, count(distinct source) as n_sources, case when center_raw = 0 then 9223372036854775807 else mad_raw * 10000 @/ abs(center_raw) end as dispersion_bps from deviations d join mads m on d.market_id = m.market_id where mad_raw = 0 or off_raw <= 3 * mad_raw group by d.market_id, mad_raw, center_raw",
    "funding_totals": f"WITHFOLD {ACCOUNTS}, paid as (select market_id, net_lots * mark_raw * 3 @/ 10000 as pay_raw, (net_lots * mark_raw * 3) % 10000 as rest from valued), booked as (select market_id, case when pay_raw > 0 then pay_raw + case when rest > 0 then 1 else 0 end else 0 end as debit_raw, case when pay_raw < 0 then -pay_raw else 0 end as credit_raw from paid) select market_id, cast(sum(debit_raw) as bigint) as paid_raw, cast(sum(credit_raw) as bigint) as received_raw, cast(sum(debit_raw) - sum(credit_raw) as bigint) as residual_raw from booked group by market_id",
    "claims_outstanding": f"with {CLAIMS} select market_id, outcome, cast(sum(units) as bigint) as units, count(*) as n_holders from claims group by market_id, outcome",
    "largest_remainder": f"with {SHARES} select market_id, account, base + case when row_number() over (partition by market_id order by rest desc, account) <= 1000003 - sum(base) over (partition by market_id) then 1 else 0 end as paid_raw from shares",
    "cumulative_targets": f"with {SHARES} select market_id, account, 1000003 * cum @/ total - 1000003 * (cum - units) @/ total as paid_raw from shares",
    "concentration_guard": f"with {CLAIMS} select market_id, max(units) * 1000000 @/ cast(sum(units) as bigint) as top_share_raw, cast(max(units) as WIDE) * 1000000 > cast(sum(units) as WIDE) * 50000 as tripped from claims group by market_id",
    "expected_utility": f"with {TICKS} select source as action, cast(sum(price_raw * weight @/ 5) as bigint) as utility_raw from ticks group by source",
    "select_action": f"with {TICKS}, u as (select market_id, source as action, cast(sum(price_raw * weight @/ 5) as bigint) as utility_raw from ticks group by market_id, source) select market_id, action, utility_raw from (select *, row_number() over (partition by market_id order by utility_raw desc, action) as r from u) t where r = 1",
    "committee_tally": f"with {TICKS}, votes as (select market_id, event_id % 997 as member, min(event_type) as claim from ticks group by market_id, event_id % 997 having count(distinct event_type) = 1), tally as (select market_id, claim, count(*) as n_votes from votes group by market_id, claim) select market_id, claim, n_votes from (select *, row_number() over (partition by market_id order by n_votes desc, claim) as r from tally) t where r = 1",
    "twap": f"with {TICKS}, steps as (select market_id, price_raw, at_us, lead(at_us) over (partition by market_id order by at_us, price_raw, event_id) - at_us as held_us from ticks) select market_id, cast(cast(sum(cast(price_raw as WIDE) * cast(held_us as WIDE)) as WIDE) @/ cast(sum(held_us) as WIDE) as bigint) as twap_raw, cast(sum(held_us) as bigint) as covered_us from steps where held_us is not null group by market_id having sum(held_us) > 0",
    "trailing_stop": f"with {TICKS} select market_id, event_id, price_raw, high_raw, price_raw <= high_raw - 100000000 as fires from (select *, max(price_raw) over (partition by market_id order by at_us, event_id rows unbounded preceding) as high_raw from ticks) t",
    "funding_index": f"with {TICKS} select market_id, event_id, cast(sum(price_raw % 1000 - 500) over (partition by market_id order by event_id rows unbounded preceding) as bigint) as index_raw from ticks",
    "idempotent_orders": f"with {FILLS} select order_id, line_no, cast(r as bigint) as attempt, r > 1 as replayed from (select order_id, line_no, row_number() over (partition by order_id, line_no order by at_us, lots, price_raw, market_id, maker) as r from fills) t",
    "tumbling_intervals": f"with {TICKS} select event_type, at_us @/ 3600000000 as hour, count(*) as n, cast(sum(price_raw) as bigint) as total_raw, max(price_raw) as top_raw from ticks group by event_type, at_us @/ 3600000000",
    "heartbeat_gaps": f"with {TICKS} select user_id, event_id, gap_us from (select user_id, event_id, at_us - lag(at_us) over (partition by user_id order by at_us, event_id) as gap_us from ticks) t where gap_us > 3600000000",
    "log2_histogram": f"with {TICKS} select event_type, least(40, case when price_raw = 0 then 0 else length(conv2(price_raw)) end) as bucket, count(*) as n, cast(sum(price_raw) as bigint) as total, max(price_raw) as top from ticks group by 1, 2",
    "throughput_rollup": f"with {TICKS} select market_id, source, count(*) as n_events, cast(sum(price_raw) as bigint) as total_raw from ticks group by rollup(market_id, source)",
    "bench_summary": f"with {TICKS} select event_type, count(*) as n, cast(sum(price_raw) as bigint) as total_ns, min(price_raw) as least_ns, max(case when r = (n * 900 + 999) @/ 1000 then price_raw end) as p90_ns, max(case when r = (n * 999 + 999) @/ 1000 then price_raw end) as p999_ns, max(price_raw) as most_ns, case when sum(price_raw) = 0 then 0 else count(*) * 1000000000 @/ cast(sum(price_raw) as bigint) end as ops from (select event_type, price_raw, row_number() over (partition by event_type order by price_raw, event_id) as r, count(*) over (partition by event_type) as n from ticks) t group by event_type",
    "replica_agreement": f"with {TICKS}, roots as (select market_id, source, sha256hex(cast(cast(sum(weight) as bigint) as string)) as root from ticks group by market_id, source) select market_id, root, n_votes from (select market_id, root, n_votes, row_number() over (partition by market_id order by n_votes desc, root) as r from (select market_id, root, count(*) as n_votes from roots group by market_id, root) v) t where r = 1",
}
TEXTS = {dialect: {name: text.replace("FOLDED", _FOLD[dialect]) for name, text in _SQL.items()} for dialect in _FOLD}
SQL = sql.oracles(TEXTS["oracle"])
QUERIES = sql.queries(TEXTS["spark"])


def query(name):
    return QUERIES[name]
